"""Joins: orders as cases, customers as owners, part brands as tags through lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("owner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def owner_join(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("tag_semi_join", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#23'))")
def tag_semi_join(spark, sf_dir):
    """Cases with any of the tags; several matching tags don't repeat a case."""
    tagged = table(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#23")).select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(tagged, "l_partkey", "left_semi")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


@query("tags_of_case", "SELECT DISTINCT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 77")
def tags_of_case(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey = 77").select("l_partkey")
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand").distinct()


@query("run_case_search", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type ILIKE '%brass%' OR p_brand ILIKE '%#12%'")
def run_case_search(spark, sf_dir):
    found = table(spark, sf_dir, "part").filter(F.col("p_type").ilike("%brass%") | F.col("p_brand").ilike("%#12%")).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(found, "l_partkey")


@query("children_collect_list", """
SELECT n_nationkey, n_name, coalesce((SELECT string_agg(s_suppkey::VARCHAR || ':' || s_name, ',' ORDER BY s_suppkey, s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation""")
def children_collect_list(spark, sf_dir):
    nested = J.children_list(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey", "suppliers", ["s_suppkey", "s_name"])
    return nested.withColumn("suppliers", F.array_join(F.transform("suppliers", lambda x: F.concat_ws(":", x["s_suppkey"].cast("string"), x["s_name"])), ","))


@query("many_to_one_load", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def many_to_one_load(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("left_lookup_default", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, l_partkey::VARCHAR) AS part_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def left_lookup_default(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.lookup(lines, "l_partkey", table(spark, sf_dir, "part").filter("p_size > 25"), "p_partkey", "p_name", "part_name")


@query("array_membership_join", """
SELECT c_custkey, count(*) AS runs FROM (SELECT o_custkey AS c_custkey, unnest(list(DISTINCT o_orderkey)) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN lineitem ON l_orderkey = id GROUP BY 1""")
def array_membership_join(spark, sf_dir):
    """Rows whose key stands in an array of ids."""
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderkey").alias("ids"))
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return ids.select("c_custkey", F.explode("ids").alias("l_orderkey")).join(runs, "l_orderkey").groupBy("c_custkey").agg(F.sum("n").alias("runs"))


@query("cross_missing_pairs", """
SELECT s_nationkey AS case_id, config FROM (SELECT DISTINCT s_nationkey FROM supplier), (SELECT DISTINCT c_mktsegment AS config FROM customer) t
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = config AND c_acctbal > 9000)""")
def cross_missing_pairs(spark, sf_dir):
    """Cases (nations) without a run in a configuration (segment)."""
    cases = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("case_id")).distinct()
    configs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("config"))
    present = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("case_id"), F.col("c_mktsegment").alias("config"))
    return J.missing_pairs(cases, configs, present)


@query("range_overlap_join", """
WITH spans AS (SELECT p_brand AS file, p_partkey AS id, p_partkey % 400 AS a, p_partkey % 400 + p_size AS b FROM part),
ranges AS (SELECT p_brand AS file, p_size AS change, min(p_partkey) % 400 AS a, min(p_partkey) % 400 + 3 AS b FROM part GROUP BY 1, 2)
SELECT r.file, change, id FROM ranges r JOIN spans s ON r.file = s.file AND r.a <= s.b AND r.b >= s.a""")
def range_overlap_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    spans = parts.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 400).alias("start"), (F.col("p_partkey") % 400 + F.col("p_size")).alias("stop"))
    ranges = parts.groupBy(F.col("p_brand").alias("file"), F.col("p_size").alias("change")).agg((F.min("p_partkey") % 400).alias("start")).withColumn("stop", F.col("start") + 3)
    return J.overlapping(ranges, spans, "file").select("file", F.col("range_change").alias("change"), F.col("span_id").alias("id"))


_VERSION = "SELECT o_custkey AS id, max(o_orderpriority) AS p, count(*) AS n, NULLIF(min(o_orderstatus), 'O') AS s FROM orders WHERE o_orderdate {} TIMESTAMP '1998-01-01' GROUP BY 1"


@query("version_diff", f"""
WITH a AS ({_VERSION.format("<")}), b AS ({_VERSION.format(">=")})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.p IS DISTINCT FROM b.p OR a.s IS DISTINCT FROM b.s""")
def version_diff(spark, sf_dir):
    def version(condition: str):
        rows = table(spark, sf_dir, "orders").filter(f"o_orderdate {condition} timestamp_ntz '1998-01-01'")
        return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("p"), F.nullif(F.min("o_orderstatus"), F.lit("O")).alias("s"))

    return J.version_diff(version("<"), version(">="), ["id"], ["p", "s"])


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@query("induced_subgraph", "SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def induced_subgraph(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s:"), "l_suppkey").alias("source"), F.concat(F.lit("p:"), "l_partkey").alias("target")).distinct()
    nodes = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("id")).union(table(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("p:"), "p_partkey")))
    return J.induced(edges, nodes, "id").select(F.substring("source", 3, 20).cast("long").alias("source"), F.substring("target", 3, 20).cast("long").alias("target"))


@query("substring_membership_join", """
WITH c AS (SELECT p_brand AS file, p_type AS cls FROM part WHERE p_size = 1 GROUP BY ALL), m AS (SELECT p_brand AS file, p_partkey AS id, p_brand || '::' || p_type || '.' || p_name AS node FROM part)
SELECT id, cls FROM m JOIN c ON m.file = c.file AND contains(node, '::' || cls || '.')""")
def substring_membership_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    classes = parts.filter("p_size = 1").select(F.col("p_brand").alias("file"), F.col("p_type").alias("cls")).distinct()
    methods = parts.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("::"), "p_type", F.lit("."), "p_name").alias("node"))
    return methods.join(classes, "file").filter(F.col("node").contains(F.concat(F.lit("::"), F.col("cls"), F.lit(".")))).select("id", "cls")


_FILE = "'f' || ({} % 50) || '.py'"


@query("priority_cascade_join", f"""
WITH calls AS (SELECT o_orderkey AS id, {_FILE.format("o_custkey")} AS file, 'C' || (o_custkey % 7) AS cls, 'n' || (o_orderkey % 90) AS name,
  CASE o_orderkey % 6 WHEN 0 THEN 'self' WHEN 1 THEN 'v' || (o_orderkey % 10) WHEN 3 THEN 'C' || (o_orderkey % 7) WHEN 4 THEN 'm' || (o_orderkey % 10) END AS scope FROM orders),
symbols AS (SELECT DISTINCT kind || '://' || file || '::' || CASE kind WHEN 'class' THEN cls WHEN 'func' THEN name ELSE CASE WHEN free THEN name ELSE cls || '.' || name END END AS id, kind, CASE kind WHEN 'class' THEN cls ELSE name END AS name
  FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'func' ELSE 'method' END AS kind, {_FILE.format("p_partkey")} AS file, 'C' || (p_partkey % 7) AS cls, 'n' || (p_partkey % 40) AS name, p_size % 5 = 0 AS free FROM part)),
locals AS (SELECT {_FILE.format("s_suppkey")} AS file, 'v' || (s_suppkey % 10) AS variable, min(CASE WHEN s_suppkey % 3 = 0 THEN {_FILE.format("(s_suppkey + 1)")} ELSE {_FILE.format("s_suppkey")} END || '::C' || (s_nationkey % 7)) AS type FROM supplier GROUP BY 1, 2),
imports AS (SELECT {_FILE.format("c_custkey")} AS file, CASE WHEN c_custkey % 2 = 0 THEN 'm' || (c_custkey % 10) ELSE 'n' || (c_custkey % 40) END AS alias, min({_FILE.format("c_nationkey")}) AS target FROM customer GROUP BY 1, 2),
found AS (SELECT c.*, type, target FROM calls c LEFT JOIN locals l ON l.file = c.file AND l.variable = c.scope LEFT JOIN imports i ON i.file = c.file AND i.alias = coalesce(c.scope, c.name)),
candidates AS (
  SELECT id, 11 AS place, 'method://' || file || '::' || cls || '.' || name AS symbol FROM found WHERE scope = 'self'
  UNION ALL SELECT id, 21, 'method://' || type || '.' || name FROM found WHERE type IS NOT NULL
  UNION ALL SELECT id, 31, 'class://' || target || '::' || name FROM found WHERE scope IS NULL AND target IS NOT NULL
  UNION ALL SELECT id, 32, 'func://' || target || '::' || name FROM found WHERE scope IS NULL AND target IS NOT NULL
  UNION ALL SELECT id, 33, 'method://' || target || '::' || name FROM found WHERE scope IS NULL AND target IS NOT NULL
  UNION ALL SELECT id, 41, 'func://' || file || '::' || name FROM found WHERE scope IS NULL
  UNION ALL SELECT id, 51, 'method://' || file || '::' || scope || '.' || name FROM found WHERE scope <> 'self' AND 'class://' || file || '::' || scope IN (SELECT id FROM symbols)
  UNION ALL SELECT id, 61, 'method://' || target || '::' || name FROM found WHERE scope <> 'self' AND target IS NOT NULL
  UNION ALL SELECT id, 62, 'method://' || target || '::' || scope || '.' || name FROM found WHERE scope <> 'self' AND target IS NOT NULL AND 'class://' || target || '::' || scope IN (SELECT id FROM symbols)
  UNION ALL SELECT id, 63, 'func://' || target || '::' || name FROM found WHERE scope <> 'self' AND target IS NOT NULL
  UNION ALL SELECT f.id, 71, s.id FROM found f JOIN (SELECT name, min(id) AS id FROM symbols WHERE kind <> 'class' GROUP BY 1) s USING (name) WHERE scope IS DISTINCT FROM 'self'),
best AS (SELECT id, min(place) AS place, arg_min(symbol, place) AS symbol FROM candidates WHERE symbol IN (SELECT id FROM symbols) GROUP BY 1)
SELECT c.id, place // 10 AS rule, symbol, CASE WHEN place // 10 IN (1, 2, 4, 5) THEN 'high' WHEN place // 10 IN (3, 6) THEN 'medium' WHEN place // 10 = 7 THEN 'low' END AS confidence FROM calls c LEFT JOIN best b ON b.id = c.id""")
def priority_cascade_join(spark, sf_dir):
    """Calls resolved to symbols by seven rules in order, over calls, symbols, local types and imports made of whole tables."""
    file = lambda c: F.concat(F.lit("f"), (c % 50).cast("string"), F.lit(".py"))
    tag = lambda p, c, n: F.concat(F.lit(p), (c % n).cast("string"))
    o, p, s, c = F.col("o_orderkey"), F.col("p_partkey"), F.col("s_suppkey"), F.col("c_custkey")
    scope = F.when(o % 6 == 0, "self").when(o % 6 == 1, tag("v", o, 10)).when(o % 6 == 3, tag("C", o, 7)).when(o % 6 == 4, tag("m", o, 10))
    calls = table(spark, sf_dir, "orders").select(o.alias("id"), file(F.col("o_custkey")).alias("file"), tag("C", F.col("o_custkey"), 7).alias("cls"), scope.alias("scope"), tag("n", o, 90).alias("name"))
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "func").otherwise("method")
    owner = F.when((kind == "method") & (F.col("p_size") % 5 != 0), tag("C", p, 7))
    symbols = table(spark, sf_dir, "part").select(kind.alias("kind"), file(p).alias("file"), owner.alias("owner"), F.when(kind == "class", tag("C", p, 7)).otherwise(tag("n", p, 40)).alias("name"))
    type_ = F.concat(F.when(s % 3 == 0, file(s + 1)).otherwise(file(s)), F.lit("::"), tag("C", F.col("s_nationkey"), 7))
    locals_ = table(spark, sf_dir, "supplier").select(file(s).alias("file"), tag("v", s, 10).alias("variable"), type_.alias("type"))
    imports = table(spark, sf_dir, "customer").select(file(c).alias("file"), F.when(c % 2 == 0, tag("m", c, 10)).otherwise(tag("n", c, 40)).alias("alias"), file(F.col("c_nationkey")).alias("target"))
    return J.resolve_calls(calls, symbols, locals_, imports).select("id", "rule", "symbol", "confidence")


@query("dangling_edges_removed", "SELECT l_orderkey, count(*) AS edges FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")
def dangling_edges_removed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey", "left_semi").join(orders, "l_orderkey", "left_semi")
    return edges.groupBy("l_orderkey").agg(F.count("*").alias("edges"))


_ENDINGS = ", ".join(f"'{e}'" for e in (*J.ENDINGS, *J.INDEX_FILES))


@query("import_resolution", f"""
WITH ends AS (SELECT unnest([{_ENDINGS}]) AS e, unnest(range(1, {len(J.ENDINGS) + len(J.INDEX_FILES) + 1})) AS i),
m AS (SELECT s_suppkey AS id, 'part' || (s_suppkey * 7 % 2500) AS module FROM supplier),
files AS (SELECT DISTINCT 'part' || (p_partkey % 2000) || e AS path FROM part JOIN ends ON i = 1 + p_partkey % {len(J.ENDINGS) + len(J.INDEX_FILES)})
SELECT m.id, arg_min(module || e, i) FILTER (WHERE path IS NOT NULL) AS path FROM m CROSS JOIN ends LEFT JOIN files ON path = module || e GROUP BY m.id""")
def import_resolution(spark, sf_dir):
    """The first of the files that a module may mean which exists."""
    modules = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("part"), (F.col("s_suppkey") * 7 % 2500).cast("string")).alias("module"))
    ends = F.array(*map(F.lit, (*J.ENDINGS, *J.INDEX_FILES)))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), (F.col("p_partkey") % 2000).cast("string"), F.element_at(ends, (1 + F.col("p_partkey") % F.size(ends)).cast("int"))).alias("path"))
    return J.first_candidate(modules, "id", J.module_files(F.col("module")), files, "path").select("id", "path")


@query("dependency_check", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderkey IS NULL THEN 'missing source step' WHEN o_orderstatus = 'P' THEN 'source not finished' ELSE 'ok' END AS verdict
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey""")
def dependency_check(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    verdict = F.when(F.col("o_orderkey").isNull(), "missing source step").when(F.col("o_orderstatus") == "P", "source not finished").otherwise("ok")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(steps, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"))
