"""Symbols, calls, routes, headings and links from source texts, by patterns or Python's own parser."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SYMBOLS = "path string, kind string, name string, qualified string, start int, stop int, doc string, decorators array<string>, returns string"
CALLS = "path string, caller string, callee string, line int, cls string, scope string, name string"
SCRIPT_SYMBOLS = "path string, kind string, name string, start int, stop int"
SCRIPT_CALLS = "path string, caller string, callee string, line int"
#: (kind, pattern, and optionally an ending of the paths it is tried in)
Pattern = tuple


def matches(files: DataFrame, path: str, text: str, patterns: Sequence[Pattern]) -> DataFrame:
    """``(path, line, kind, a, b)``: every match of every pattern in every line, with its first two groups (empty if there are fewer).

    A text is split once and all patterns are tried in one projection. A pattern of more than a line is none of this function's.
    """

    def of_line(x: Column, i: Column) -> Column:
        def found(kind: str, pattern: str, endings: str | None = None) -> Column:
            hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
            group = lambda m, g: F.regexp_extract(m, pattern, g) if re.compile(pattern).groups >= g else F.lit("")
            rows = F.transform(hits, lambda m: F.struct((i + 1).alias("line"), F.lit(kind).alias("kind"), group(m, 1).alias("a"), group(m, 2).alias("b")))
            return rows if endings is None else F.when(F.rlike(F.col("path").cast("string"), F.lit(endings)), rows).otherwise(F.filter(rows, lambda _: F.lit(False)))

        return F.concat(*[found(*p) for p in patterns])

    lines = files.select(F.col(path).alias("path"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    return lines.select("path", F.explode(F.flatten(F.transform("lines", of_line))).alias("s")).select("path", "s.*")


def nearest_heading(files: DataFrame, path: str, text: str, marked: str) -> DataFrame:
    """``(path, line, heading)`` of lines that fit a pattern, with the last heading above or on them; null above the first.

    Only headings and marked lines are kept; the heading is the last one by a window over the lines of a file.
    """
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "x"))
    title = F.when(F.rlike("x", F.lit(_HEADING)), F.regexp_extract("x", _HEADING, 2))
    kept = lines.select("path", (F.col("n") + 1).alias("line"), title.alias("title"), F.rlike("x", F.lit(marked)).alias("hit")).filter("hit or title is not null")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("heading", F.last("title", ignorenulls=True).over(w)).filter("hit").select("path", "line", "heading")


_HEADING = r"^(#{1,4}) +([^\r]*?)[ \r]*$"


def headings(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, level, title)`` of Markdown headings of levels 1 to 4."""
    return matches(files, path, text, [("heading", _HEADING)]).select("path", "line", F.length("a").alias("level"), F.col("b").alias("title"))


def links(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, target)`` of relative Markdown links, without anchors."""
    target = F.explode(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)#\s]+)"), 1)).alias("target")
    return files.select(F.col(path).alias("path"), target).filter(~F.col("target").rlike("^[a-z]+:"))


def hrefs(pages: DataFrame, path: str, html: str) -> DataFrame:
    """``(path, target)`` of the links of HTML pages."""
    return pages.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("target"))


def imports(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, kind, name)`` of what JavaScript and TypeScript files import or require; all of a line."""
    patterns = [("import", r"""\bimport\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]"""), ("require", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""")]
    return matches(files, path, text, patterns).select("path", "line", "kind", F.col("a").alias("name"))


def heritage(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, child, parent, kind)`` of class declarations in Python, JavaScript or TypeScript; a row per EXTENDS or IMPLEMENTS."""
    patterns = [
        ("EXTENDS", r"\bclass\s+(\w+)\s*\(([^)]*)\)\s*:"),
        ("EXTENDS", r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+(\w+)"),
        ("IMPLEMENTS", r"\bclass\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+\w+(?:<[^>]*>)?)?\s+implements\s+([\w\s,<>]+)"),
    ]
    rows = matches(files, path, text, patterns).select("path", "line", F.col("a").alias("child"), F.explode(F.split("b", ",")).alias("parent"), "kind")
    return rows.withColumn("parent", F.trim("parent")).filter("parent <> '' and parent not like '%=%'").distinct()


_TEXT = r"""['"`]([^'"`]+)['"`]"""
_WORD = r"[A-Za-z_]\w*"
_PY, _JS = r"\.pyi?$", r"\.[jtcm]*[jt]sx?$"
_HTTP = ("get", "post", "put", "patch", "delete", "head", "options")


def call_with_text(receivers: Sequence[str], verbs: Sequence[str], mark: str = r"\b", joint: str = r"\.", keep_verb: bool = True) -> str:
    """The pattern of a call: a mark, a receiver, a joint, a verb, a bracket and a quoted text; groups are the verb, if it is kept, and the text."""
    start = f"(?:{'|'.join(receivers)})\\s*{joint}\\s*" if receivers else ""
    return rf"{mark}{start}({'' if keep_verb else '?:'}{'|'.join(verbs)})\s*\(\s*{_TEXT}"


def _titles(*words: str) -> list[str]:
    return [w.capitalize() for w in words]


#: (framework, pattern, endings): route declarations; groups are a method, or nothing, and a URL. Receivers and verbs are those that the frameworks' guides use.
ROUTES = (
    ("fastapi", call_with_text([_WORD], [*_HTTP, "trace"], mark=r"@\s*"), _PY),
    ("express", call_with_text([r"\w*[aA]pp", r"\w*[rR]outer", "server", "api"], [*_HTTP, "all", "use"]), _JS),
    ("nest", call_with_text([], _titles(*_HTTP, "all"), mark="@"), r"\.ts$"),
    ("spring", call_with_text([], [f"{v}(?=Mapping)" for v in _titles("get", "post", "put", "patch", "delete")], mark="@").replace(r")\s*\(", r")Mapping\s*\("), r"\.java$"),
    ("laravel", call_with_text(["Route"], [*_HTTP, "any"], joint="::"), r"\.php$"),
)
FLASK = ("flask", call_with_text([_WORD], ["route"], mark=r"@\s*", keep_verb=False) + r"(?:[^)\n]*?\bmethods\s*=\s*[\[(]([^\])\n]*))?", _PY)
DJANGO = ("django", call_with_text([], ["path", "re_path"], keep_verb=False), r"(^|/)urls\.py$")


def routes(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, method, url, framework)``: all route declarations of common frameworks, the first one per method and URL.

    Decorators, calls and facades by pattern, where the file's ending fits; Next.js pages and handlers (line 0, methods GET and API)
    by their paths. URLs begin with a slash and don't end with one; [id] is written {id}.
    """
    hits = matches(files, path, text, [*ROUTES, FLASK, DJANGO])
    flask, django = F.col("kind") == "flask", F.col("kind") == "django"
    named = F.transform(F.split(F.when(F.col("b") == "", F.lit("GET")).otherwise(F.col("b")), ","), lambda m: F.upper(F.regexp_replace(m, r"""['"\s]""", "")))
    rows = hits.select("path", "line", F.explode(F.when(flask, named).when(django, F.array(F.lit("GET"))).otherwise(F.array(F.upper("a")))).alias("method"), F.when(flask | django, F.col("a")).otherwise(F.col("b")).alias("url"), F.col("kind").alias("framework"))
    name = F.concat(F.lit("/"), F.replace(F.col(path).cast("string"), F.lit("\\"), F.lit("/")))
    page = F.regexp_extract(name, r"/app/(?:(.*)/)?(?:page\.[jt]sx?|layout\.[jt]sx)$", 1)
    handler = F.regexp_extract(name, r"/app/(?:(.*)/)?route\.[jt]s$", 1)
    pages = F.regexp_replace(F.regexp_extract(name, r"/pages/(.*)\.[jt]sx?$", 1), "(^|/)index$", "")
    fits = lambda p: F.rlike(name, F.lit(p))
    url = F.when(fits(r"/app/(?:.*/)?(?:page\.[jt]sx?|layout\.[jt]sx)$"), page).when(fits(r"/app/(?:.*/)?route\.[jt]s$"), handler).when(fits(r"/pages/.*\.[jt]sx?$"), pages)
    method = F.when(fits(r"/app/(?:.*/)?route\.[jt]s$"), "API").otherwise("GET")
    by_path = files.select(F.col(path).alias("path"), F.lit(0).alias("line"), method.alias("method"), url.alias("url"), F.lit("nextjs").alias("framework")).filter("url is not null")
    both = rows.union(by_path)
    slash = F.regexp_replace(F.when(F.startswith("url", F.lit("/")), F.col("url")).otherwise(F.concat(F.lit("/"), "url")), r"\[(\w+)\]", "{$1}")
    clean = both.withColumn("url", F.when(F.length(slash) > 1, F.regexp_replace(slash, "/$", "")).otherwise(slash))
    return clean.groupBy("method", "url").agg(F.min(F.struct("path", "line", "framework")).alias("f")).select("f.path", "f.line", "method", "url", "f.framework")


def tools(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, name, description)`` of tools: decorated functions, classes that extend a tool, and objects with name and description.

    Descriptions are cut at 200 characters. The first of each name in a file counts, in that order of forms.
    """
    forms = (
        (r"""name\s*:\s*['"](\w+)['"]\s*,\s*description\s*:\s*(?:'([^']*)'|"([^"]*)"|`([^`]*)`)""", (1,), (2, 3, 4)),
        (r'''@(?:\w+\.)?tool\s*(?:\(\s*(?:["']([^"']+)["'])?[^)]*\))?\s*\n\s*(?:async\s+)?def\s+(\w+)\([^)]*\)[^:]*:[ \t]*(?:\n\s*"""([^"]*))?''', (1, 2), (3,)),
        (r"\bclass\s+(\w*Tool)\b\s*\([^)]*Tool\b[^)]*\)", (1,), ()),
    )

    def of_form(number: int, pattern: str, names: tuple, descriptions: tuple) -> Column:
        first = lambda m, groups: F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) for g in groups], F.lit(""))
        described = lambda m: F.substring(F.trim(F.regexp_replace(first(m, descriptions), r"\\n|\n", " ")), 1, 200)
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda m, i: F.struct(F.lit(number).alias("form"), i.alias("i"), first(m, names).alias("name"), described(m).alias("description")))

    rows = files.select(F.col(path).alias("path"), F.explode(F.concat(*[of_form(n, *f) for n, f in enumerate(forms)])).alias("t")).select("path", "t.*")
    return rows.groupBy("path", "name").agg(F.min(F.struct("form", "i", "description")).alias("t")).select("path", "name", "t.description")


def orm_usage(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, model, orm, method)`` of ORM calls, once per file."""
    dotted = lambda verbs: rf"({_WORD})\.({'|'.join(verbs)})\s*\("
    managers = ("get", "filter", "exclude", "all", "create", "bulk_create", "get_or_create", "update_or_create", "update", "delete", "first", "last", "count", "exists")
    queries = [f"{verb}{form}" for verb, forms in (("find", ("Unique", "UniqueOrThrow", "First", "FirstOrThrow", "Many")), ("create", ("", "Many")), ("update", ("", "Many")), ("delete", ("", "Many"))) for form in forms]
    patterns = [
        ("django", r"\b" + dotted(managers).replace(r"\.(", r"\.objects\.(")),
        ("sqlalchemy", rf"\b(?:\w*[sS]ession|db)\.(query|get)\(\s*({_WORD})"),
        ("sqlalchemy", rf"(?<![.\w])(select)\(\s*({_WORD})"),
        ("prisma", r"\b[pP]risma\." + dotted([*queries, "upsert", "count", "aggregate", "groupBy"])),
        ("supabase", r"\b[sS]upabase\.(from)\(\s*" + _TEXT),
    ]
    first = F.col("kind").isin("django", "prisma")
    rows = matches(files, path, text, patterns)
    return rows.select("path", F.when(first, F.col("a")).otherwise(F.col("b")).alias("model"), F.col("kind").alias("orm"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("method")).distinct()


_DECLARED = (
    ("class", re.compile(r"\bclass\s+(\w+)")),
    ("interface", re.compile(r"\binterface\s+(\w+)")),
    ("enum", re.compile(r"\benum\s+(\w+)")),
    ("function", re.compile(r"\bfunction\s*\*?\s*(\w+)\s*\(")),
    ("function", re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::[^=\n]+)?=>")),
    ("method", re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{", re.MULTILINE)),
)
_CALLED = re.compile(r"(\bthis\.|\bself\.|(?<![.\w]))([A-Za-z_]\w*)\s*\((?=([^)]*))")
#: Words before a bracket that call nothing.
_NO_CALLS = frozenset("if for while switch catch function typeof instanceof return throw yield import export new delete void try class extends implements".split())


def _script_symbols(path: str, text: str | None) -> list[tuple]:
    """Declarations with the lines of their blocks, which end where braces are even again; a declaration without a block is one line."""
    text = text or ""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    found = []
    for kind, pattern in _DECLARED:
        for m in pattern.finditer(text):
            if m[1] in _NO_CALLS:
                continue
            depth, end, at = 0, m.end(1), m.end() - (kind == "method")
            while at < len(text) and (c := text[at]) not in ";\n" or depth:
                if at >= len(text):
                    break
                depth += (c == "{") - (c == "}") if (c := text[at]) in "{}" else 0
                at += 1
                if c == "}" and depth <= 0:
                    break
            end = max(end, min(at, len(text)) - 1)
            found.append((path, kind, m[1], line(m.start(1)), line(end)))
    return sorted(set(found), key=lambda r: (r[3], -r[4], r[1]))


def _script_calls(path: str, text: str | None) -> list[tuple]:
    """Calls of the file's own functions, and of its methods by this or self, inside its functions and methods."""
    text = text or ""
    blocks = [(k, n, a, b) for _, k, n, a, b in _script_symbols(path, text) if k in ("function", "method")]
    functions, methods = {n for k, n, *_ in blocks if k == "function"}, {n for k, n, *_ in blocks if k == "method"}
    found = []
    for m in _CALLED.finditer(text):
        name, before = m[2], text[: m.start(2)].rstrip()
        declared = before.endswith("function") or before.endswith("*")
        if name in _NO_CALLS or "=>" in m[3] or "{" in m[3] or declared or name not in (methods if m[1] else functions):
            continue
        line = text.count("\n", 0, m.start(2)) + 1
        around = [x for x in blocks if x[2] <= line <= x[3]]
        if around:
            found.append((path, min(around, key=lambda x: x[3] - x[2])[1], name, line))
    return found


def script_symbols(files: DataFrame, path: str, text: str) -> DataFrame:
    """Classes, interfaces, enums, functions (arrow ones too) and methods of JavaScript and TypeScript files, with the lines of their blocks."""
    return _parsed(files, path, text, _script_symbols, SCRIPT_SYMBOLS)


def script_calls(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, caller, callee, line)`` of JavaScript and TypeScript files; the caller is the innermost function or method around a call."""
    return _parsed(files, path, text, _script_calls, SCRIPT_CALLS)


def _module(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError):
        return None


def _symbols(path: str, text: str | None) -> list[tuple]:
    found: list[tuple] = []

    def walk(node: ast.AST, outer: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{outer}.{child.name}" if outer else child.name
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                found.append((path, "class" if is_class else "method" if in_class else "function", child.name, name, child.lineno, child.end_lineno, ast.get_docstring(child), [ast.unparse(d) for d in child.decorator_list], returns))
                walk(child, name, is_class)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = f"{getattr(child, 'module', None)}." if getattr(child, "module", None) else ""
                found.extend((path, "import", a.asname or a.name, base + a.name, child.lineno, child.end_lineno, None, [], None) for a in child.names)
            elif isinstance(child, ast.Assign) and not outer:
                found.extend((path, "variable", t.id, t.id, child.lineno, child.end_lineno, None, [], None) for t in child.targets if isinstance(t, ast.Name))
            else:
                walk(child, outer, in_class)

    if tree := _module(text):
        name = str(path).replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".py")
        found.append((path, "module", name, str(path), 1, (text or "").count("\n") + 1, ast.get_docstring(tree), [], None))
        walk(tree, "", False)
    return found


def _calls(path: str, text: str | None) -> list[tuple]:
    found: list[tuple] = []

    def walk(node: ast.AST, caller: str, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Call):
                f = child.func
                plain = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name)
                scope = f.value.id if plain else None
                name = f.id if isinstance(f, ast.Name) else f.attr if plain else None
                found.append((path, caller, ast.unparse(f), child.lineno, cls, scope, name))
            if isinstance(child, ast.ClassDef):
                walk(child, f"{caller}.{child.name}".lstrip("."), child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                walk(child, f"{caller}.{child.name}".lstrip("."), cls)
            else:
                walk(child, caller, cls)

    if tree := _module(text):
        walk(tree, "", None)
    return found


def _parsed(files: DataFrame, path: str, text: str, f, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for p, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for row in f(p, t)], columns=names)

    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInPandas(run, schema)


def python_symbols(files: DataFrame, path: str, text: str) -> DataFrame:
    """Classes, functions, methods, imports and module variables of Python files; none where they don't parse."""
    return _parsed(files, path, text, _symbols, SYMBOLS)


def python_calls(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, caller, callee, line, cls, scope, name)`` of Python files; the caller is empty at module level.

    cls, scope and name are what ``joins.resolve_calls`` takes; scope and name are null where a call is of no name or attribute of one.
    """
    return _parsed(files, path, text, _calls, CALLS)
