"""Extraction from documents and pages, and from source texts that a query makes up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extract as X
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("markdown_headings", """
SELECT doc_id AS path, 1 AS line, 1 + (doc_id % 4)::INTEGER AS level, lang || ' ' || doc_id AS title FROM documents WHERE doc_id % 7 <> 6 UNION ALL SELECT doc_id, 3, 2, 'End' FROM documents WHERE doc_id % 7 <> 6""")
def markdown_headings(spark, sf_dir):
    """Headings of texts made of a document's columns; five marks are no heading."""
    marks = F.when(F.col("doc_id") % 7 == 6, F.lit("#####")).otherwise(F.repeat(F.lit("#"), (F.col("doc_id") % 4 + 1).cast("int")))
    end = F.when(F.col("doc_id") % 7 == 6, F.lit("#End")).otherwise("## End  ")
    text = F.concat(marks, F.lit(" "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\nno # heading\n"), end)
    return X.headings(table(spark, sf_dir, "documents").select("doc_id", text.alias("md")), "doc_id", "md")


@query("markdown_links", "SELECT doc_id AS path, 'docs/' || lang || '.md' AS target FROM documents")
def markdown_links(spark, sf_dir):
    text = F.format_string("see [a](docs/%s.md#part) and [b](https://x.example/%d) and [c](#here)", "lang", "doc_id")
    return X.links(table(spark, sf_dir, "documents").select("doc_id", text.alias("md")), "doc_id", "md")


@query("link_extract", "SELECT page_id AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def link_extract(spark, sf_dir):
    return X.hrefs(table(spark, sf_dir, "pages"), "page_id", "html")


@query("nearest_heading", """
SELECT doc_id AS path, line, CASE WHEN line > 2 AND doc_id % 3 <> 1 THEN 'Part ' || lang WHEN line > 4 THEN 'Late' END AS heading FROM documents, (VALUES (1), (3), (5)) t(line)""")
def nearest_heading(spark, sf_dir):
    second = F.when(F.col("doc_id") % 3 == 1, F.lit("##### no heading")).otherwise(F.concat(F.lit("## Part "), "lang"))
    fourth = F.when(F.col("doc_id") % 3 == 1, F.lit("# Late")).otherwise("plain")
    text = F.concat_ws("\n", F.lit("see [x](y)"), second, F.lit("see [x](y)"), fourth, F.lit("see [x](y)"))
    return X.nearest_heading(table(spark, sf_dir, "documents").select("doc_id", text.alias("md")), "doc_id", "md", r"\[x\]")


@query("script_symbols", """
SELECT 's' || s_suppkey || '.ts' AS path, kind, CASE kind WHEN 'class' THEN 'S' || s_suppkey WHEN 'interface' THEN 'I' || s_nationkey WHEN 'method' THEN 'run' ELSE CASE start WHEN 1 THEN 'f' || s_suppkey ELSE 'g' END END AS name, start,
  CASE WHEN start = 2 THEN 6 + s_suppkey % 3 WHEN kind = 'method' THEN 5 + s_suppkey % 3 ELSE start + off END AS stop
FROM supplier, (VALUES ('function', 1, 0), ('class', 2, 0), ('method', 3, 0)) t(kind, start, off)
UNION ALL SELECT 's' || s_suppkey || '.ts', 'interface', 'I' || s_nationkey, 7 + s_suppkey % 3, 7 + s_suppkey % 3 FROM supplier UNION ALL SELECT 's' || s_suppkey || '.ts', 'function', 'g', 8 + s_suppkey % 3, 10 + s_suppkey % 3 FROM supplier""")
def script_symbols(spark, sf_dir):
    return X.script_symbols(_scripts(spark, sf_dir), "path", "text")


def _scripts(spark, sf_dir):
    """Files of a class with a method of several lines, an arrow function, an interface and a function."""
    lines = F.repeat(F.lit("    if (a) { this.run(a) }\n"), (F.col("s_suppkey") % 3).cast("int"))
    head = F.format_string("const f%d = async (a) => g(a)\nexport class S%d extends B {\n  run(a: number): void {\n    f%d(a)\n", "s_suppkey", "s_suppkey", "s_suppkey")
    tail = F.format_string("  }\n}\nexport interface I%d { x: number }\nfunction g(b) {\n  return require('./n%d') + require('./m')\n}\n", "s_nationkey", "s_nationkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(head, lines, tail).alias("text"))


@query("script_calls", """
SELECT 's' || s_suppkey || '.ts' AS path, 'f' || s_suppkey AS caller, 'g' AS callee, 1 AS line FROM supplier UNION ALL SELECT 's' || s_suppkey || '.ts', 'run', 'f' || s_suppkey, 4 FROM supplier
UNION ALL SELECT 's' || s_suppkey || '.ts', 'run', 'run', 5 + i FROM supplier, (VALUES (0), (1)) t(i) WHERE i < s_suppkey % 3""")
def script_calls(spark, sf_dir):
    return X.script_calls(_scripts(spark, sf_dir), "path", "text")


@query("script_imports", """
SELECT 's' || s_suppkey || '.ts' AS path, 9 + s_suppkey % 3 AS line, 'require' AS kind, unnest(['./n' || s_nationkey, './m']) AS name FROM supplier""")
def script_imports(spark, sf_dir):
    """Two on one line are both found."""
    return X.imports(_scripts(spark, sf_dir), "path", "text")


@query("route_extract", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 6 AS kind FROM supplier), f AS (
  SELECT 'a' || lpad(k::VARCHAR, 6, '0') || '.py' AS path, 1 AS line, 'GET' AS method, '/n/' || n || '/{id}' AS url, 'fastapi' AS framework FROM s WHERE kind = 0
  UNION ALL SELECT 'a' || lpad(k::VARCHAR, 6, '0') || '.py', 2, unnest(['GET', 'POST']), '/flask/' || n, 'flask' FROM s WHERE kind = 0 UNION ALL SELECT 'a' || lpad(k::VARCHAR, 6, '0') || '.py', 3, 'GET', '/plain', 'flask' FROM s WHERE kind = 0
  UNION ALL SELECT 'b' || lpad(k::VARCHAR, 6, '0') || '.js', 1, unnest(['POST', 'USE']), unnest(['/all', '/n' || n]), 'express' FROM s WHERE kind = 1
  UNION ALL SELECT 'c' || lpad(k::VARCHAR, 6, '0') || '.php', 1, 'ANY', '/x/' || n, 'laravel' FROM s WHERE kind = 2
  UNION ALL SELECT 'd' || lpad(k::VARCHAR, 6, '0') || '/urls.py', 1, 'GET', '/django/' || n, 'django' FROM s WHERE kind = 3
  UNION ALL SELECT 'web/app/p' || n || '/[id]/page.tsx', 0, 'GET', '/p' || n || '/{id}', 'nextjs' FROM s WHERE kind = 4 UNION ALL SELECT 'web/pages/q' || n || '/index.tsx', 0, 'GET', '/q' || n, 'nextjs' FROM s WHERE kind = 5)
SELECT r.path, r.line, method, url, r.framework FROM (SELECT method, url, min({'path': path, 'line': line, 'framework': framework}) AS r FROM f GROUP BY 1, 2)""")
def route_extract(spark, sf_dir):
    """Files of six frameworks, some lines with two declarations."""
    kind, n = F.col("s_suppkey") % 6, F.col("s_nationkey")
    name = lambda p, e: F.concat(F.lit(p), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(e))
    web = lambda p, e: F.concat(F.lit(p), n.cast("string"), F.lit(e))
    path = F.when(kind == 0, name("a", ".py")).when(kind == 1, name("b", ".js")).when(kind == 2, name("c", ".php")).when(kind == 3, name("d", "/urls.py")).when(kind == 4, web("web/app/p", "/[id]/page.tsx")).otherwise(web("web/pages/q", "/index.tsx"))
    python = F.format_string("@router.get(\"n/%d/[id]/\")\n@app.route('/flask/%d', methods=['GET', \"POST\"])\n@bp.route('/plain')\nrouter.post('/none')", n, n)
    text = F.when(kind == 0, python).when(kind == 1, F.format_string("app.post('/all', f); router.use(`/n%d`, g)\nRoute::get('/none')", n)).when(kind == 2, F.format_string("Route::any('/x/%d', f)", n)).when(kind == 3, F.format_string("    path('django/%d/', view),", n)).otherwise("export default f")
    return X.routes(table(spark, sf_dir, "supplier").select(path.alias("path"), text.alias("t")), "path", "t")


@query("symbols_python", """
SELECT s_suppkey || '.py' AS path, kind, CASE kind WHEN 'class' THEN 'C' || s_suppkey WHEN 'module' THEN s_suppkey::VARCHAR ELSE 'm' || i END AS name, CASE kind WHEN 'method' THEN 3 + 2 * i ELSE 1 END AS start, CASE kind WHEN 'class' THEN 'n' || s_nationkey END AS doc, CASE WHEN kind = 'method' AND i > 0 THEN 'int' END AS returns
FROM supplier, (VALUES ('class', 0), ('module', 0), ('method', 0), ('method', 1), ('method', 2)) t(kind, i) WHERE i <= s_suppkey % 3 AND s_suppkey % 5 <> 4""")
def symbols_python(spark, sf_dir):
    """Classes of one to three methods; files that don't parse have no symbols."""
    second = F.when(F.col("s_suppkey") % 3 > 0, "    def m1(self) -> int:\n        return 1\n").otherwise("")
    third = F.when(F.col("s_suppkey") % 3 > 1, "    def m2(self) -> int:\n        return 1\n").otherwise("")
    text = F.concat(F.format_string('class C%d:\n    "n%d"\n    def m0(self):\n        return 1\n', "s_suppkey", "s_nationkey"), second, third, F.when(F.col("s_suppkey") % 5 == 4, "def (").otherwise(""))
    return X.python_symbols(table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), text.alias("py")), "path", "py").select("path", "kind", "name", "start", "doc", "returns")


@query("calls_python", """
SELECT s_suppkey::VARCHAR AS path, caller, callee, line, cls, scope, name FROM (
  SELECT s_suppkey, 'C.f' AS caller, 'g' || s_nationkey AS callee, 3 AS line, 'C' AS cls, NULL AS scope, 'g' || s_nationkey AS name FROM supplier UNION ALL SELECT s_suppkey, 'C.f', 'self.h', 3, 'C', 'self', 'h' FROM supplier
  UNION ALL SELECT s_suppkey, '', 'a.b.c', 4, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, '', 'm.k' || s_suppkey, 4, NULL, 'm', 'k' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)""")
def calls_python(spark, sf_dir):
    last = F.when(F.col("s_suppkey") % 2 == 0, "a.b.c()").otherwise(F.format_string("m.k%d()", "s_suppkey"))
    text = F.concat(F.format_string("class C:\n  def f(self):\n    return g%d(self.h(1))\n", "s_nationkey"), last)
    return X.python_calls(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("py")), "s_suppkey", "py")


@query("class_heritage", """
SELECT s_suppkey AS path, 1 AS line, 'A' || s_suppkey AS child, unnest(['B' || s_nationkey, 'c.D']) AS parent, 'EXTENDS' AS kind FROM supplier UNION ALL SELECT s_suppkey, 2, 'E', 'F', 'EXTENDS' FROM supplier
UNION ALL SELECT s_suppkey, 2, 'E', unnest(['G', 'H<T>']), 'IMPLEMENTS' FROM supplier UNION ALL SELECT s_suppkey, 2, 'X', 'Y' || s_nationkey, 'EXTENDS' FROM supplier""")
def class_heritage(spark, sf_dir):
    text = F.format_string("class A%d(B%d, c.D, metaclass=M):\nclass E extends F implements G, H<T> {} class X extends Y%d {", "s_suppkey", "s_nationkey", "s_nationkey")
    return X.heritage(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("t")), "s_suppkey", "t")


@query("tool_definitions", """
SELECT s_suppkey AS path, 't' || s_suppkey AS name, 'Finds ' || s_name AS description FROM supplier UNION ALL SELECT s_suppkey, 'named_' || s_nationkey, '' FROM supplier
UNION ALL SELECT s_suppkey, 'N' || s_nationkey || 'Tool', '' FROM supplier UNION ALL SELECT s_suppkey, 'js' || s_suppkey, 'two lines of ' || s_name FROM supplier""")
def tool_definitions(spark, sf_dir):
    text = F.format_string('@server.tool()\nasync def t%d(x: int) -> str:\n    """Finds %s """\n@tool("named_%d")\ndef u(): pass\nclass N%dTool(BaseTool):\n  {name: "js%d", description: `two lines\nof %s`}', "s_suppkey", "s_name", "s_nationkey", "s_nationkey", "s_suppkey", "s_name")
    return X.tools(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("t")), "s_suppkey", "t")


@query("orm_usage", """
SELECT s_suppkey AS path, unnest(['M' || s_nationkey, 'User', 'A', 'B' || s_suppkey, 'post', 'items_' || s_nationkey]) AS model, unnest(['sqlalchemy', 'sqlalchemy', 'django', 'sqlalchemy', 'prisma', 'supabase']) AS orm, unnest(['select', 'get', 'filter', 'query', 'findMany', 'from']) AS method FROM supplier""")
def orm_usage(spark, sf_dir):
    text = F.format_string("a = select(M%d.x); b = await session.get(User, 1)\nc = session.get(User, 2)\nA.objects.filter(x) or db.query(B%d)\nprisma.post.findMany() && supabase.from('items_%d')", "s_nationkey", "s_suppkey", "s_nationkey")
    return X.orm_usage(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("t")), "s_suppkey", "t")
