"""Scenario runs: templates, mappings, extractors, assertions, the stop rule; reports and diffs as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.rounds import settled


def _filled(text: Column, hole: str, values: Column) -> Column:
    """Each hole of a text replaced by the value of the name in it, once; unknown and null ones stay."""
    tokens = F.regexp_extract_all(text, F.lit(rf"{hole}|[^{{]+|\{{"), F.lit(0))
    name = lambda t: F.regexp_extract(t, f"^{hole}$", 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(name(t) != "", F.coalesce(F.try_element_at(values, name(t)), t)).otherwise(t)), "")


def substitute(text: Column, variables: Column) -> Column:
    """``{{name}}`` replaced by the value of a map; unknown names stay, a dotted name is one key. What a value holds is not replaced again."""
    return _filled(text, r"\{\{(\w+(?:\.\w+)*)\}\}", variables)


def path_parameters(path: Column, values: Column) -> Column:
    """``{id}`` of a path replaced by the value of a map."""
    return _filled(path, r"\{(\w+)\}", values)


def mapped(source: Column, previous: Column, path: Column, variables: Column, static: Column) -> Column:
    """The value of a mapping by its source: previous_response (JSON by a path), variable, static; else null."""
    from_response = F.try_variant_get(F.try_parse_json(previous), path, "string")
    return F.when(source == "previous_response", from_response).when(source == "variable", F.try_element_at(variables, path)).when(source == "static", static)


#: Transforms that a mapping may name; nothing is evaluated.
TRANSFORMS = {
    "upper": F.upper,
    "lower": F.lower,
    "strip": F.trim,
    "int": lambda c: c.try_cast("long").cast("string"),
    "length": lambda c: F.length(c).cast("string"),
    "first8": lambda c: F.substring(c, 1, 8),
}


def transformed(value: Column, name: Column) -> Column:
    """A named transform of a value; the value itself if there is no such transform or it fails."""
    out = value
    for k, f in TRANSFORMS.items():
        out = F.when(name == k, F.coalesce(f(value), value)).otherwise(out)
    return out


def compare(actual: Column, operator: Column, expected: Column) -> Column:
    """eq, ne, gt, lt or contains on text, numbers where both are; anything else, or a missing value, is false."""
    a, b = actual.try_cast("double"), expected.try_cast("double")
    order = lambda x, y, s, t: F.when(x.isNotNull() & y.isNotNull(), x > y).otherwise(s > t)
    found = F.when(operator == "eq", actual == expected).when(operator == "ne", actual != expected).when(operator == "gt", order(a, b, actual, expected)).when(operator == "lt", order(b, a, expected, actual)).when(operator == "contains", F.contains(actual, expected))
    return F.coalesce(found, F.lit(False))


def assertions(steps: DataFrame) -> DataFrame:
    """Steps with ``passed`` and ``first_error``.

    steps: status_code, headers (map), body (JSON) and assertions, an array of (type, path, operator, expected).
    """
    body = F.try_parse_json("body")

    def result(a: Column) -> Column:
        actual = F.when(a["type"] == "status", F.col("status_code").cast("string")).when(a["type"] == "header", F.try_element_at("headers", a["path"])).when(a["type"] == "jsonpath", F.try_variant_get(body, a["path"], "string"))
        return F.struct(compare(actual, a["operator"], a["expected"]).alias("ok"), F.concat_ws(" ", a["type"], F.coalesce(a["path"], F.lit("")), a["operator"], a["expected"], F.lit("but was"), F.coalesce(actual, F.lit("null"))).alias("text"))

    failed = F.filter(F.transform("assertions", result), lambda r: ~r["ok"])
    return steps.withColumn("_failed", failed).withColumn("passed", F.size("_failed") == 0).withColumn("first_error", F.get("_failed", F.lit(0))["text"]).drop("_failed")


def stopped(steps: DataFrame, run: str = "run_id", order: str = "step_order") -> DataFrame:
    """Steps up to the first that failed and doesn't continue; later ones are ``skipped``.

    The stop is one aggregate per run, joined back: no run is sorted.
    """
    stop = steps.filter((F.col("status") == "failed") & ~F.coalesce("continue_on_failure", F.lit(False))).groupBy(run).agg(F.min(order).alias("_stop"))
    joined = steps.join(stop, run, "left")
    return joined.withColumn("status", F.when(F.col(order) > F.col("_stop"), "skipped").otherwise(F.col("status"))).drop("_stop")


#: Words in a step's name that suggest an HTTP method, in the order they are tried.
METHOD_WORDS = {"POST": ("创建", "新建", "添加", "create", "add", "new"), "GET": ("获取", "查询", "get", "fetch", "list"), "PUT": ("更新", "修改", "update", "edit", "modify"), "DELETE": ("删除", "delete", "remove")}


def method_of(name: Column) -> Column:
    """The HTTP method that a step's name suggests, in English or Chinese, as it is written; POST by default."""
    out = F.when(F.lit(False), "")
    for method, words in METHOD_WORDS.items():
        out = out.when(F.rlike(F.coalesce(name, F.lit("")), F.lit("|".join(words))), method)
    return out.otherwise("POST")


def endpoint_of(test_name: Column) -> Column:
    """The struct (endpoint, method) of a test's name such as ``GET /users``; without a method the whole name, and GET."""
    pattern = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(.+)$"
    named = F.rlike(test_name, F.lit(pattern))
    return F.struct(F.when(named, F.regexp_extract(test_name, pattern, 2)).otherwise(test_name).alias("endpoint"), F.when(named, F.regexp_extract(test_name, pattern, 1)).otherwise("GET").alias("method"))


def resolved(method: Column, path: Column, parameters: Column, override: Column, headers: Column, mappings: Column, variables: Column) -> Column:
    """A request as the struct (method, url, params, headers, body) from an endpoint and its step.

    parameters: the endpoint's, as structs (place, name, default), place query or header. override: a struct (method, url, params,
    body), nulls where nothing is overridden. headers: a map laid over the endpoint's. mappings: a map from ``params.x``,
    ``headers.x`` or ``body`` to values, laid over all. Variables are filled in last.
    """
    of = lambda place: F.map_from_entries(F.transform(F.filter(parameters, lambda p: p["place"] == place), lambda p: F.struct(p["name"], p["default"])))
    under = lambda prefix: F.transform_keys(F.map_filter(mappings, lambda k, _: F.startswith(k, F.lit(prefix))), lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fill = lambda m: F.transform_values(m, lambda _, v: substitute(v, variables))
    return F.struct(
        F.coalesce(override["method"], method, F.lit("POST")).alias("method"),
        substitute(F.coalesce(override["url"], path, F.lit("/")), variables).alias("url"),
        fill(laid_over(laid_over(of("query"), F.coalesce(override["params"], empty)), under("params."))).alias("params"),
        fill(laid_over(laid_over(of("header"), F.coalesce(headers, empty)), under("headers."))).alias("headers"),
        substitute(F.coalesce(F.try_element_at(mappings, F.lit("body")), override["body"]), variables).alias("body"),
    )


def laid_over(below: Column, above: Column) -> Column:
    """A map with the entries of another over its own."""
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)


def set_nested(json_: Column, path: Sequence[str], value: Column) -> Column:
    """A JSON object with a value at a path of keys; objects on the way are made where they are missing or no objects.

    Built from the inside: each level is the object's other keys and the one that changes, so keys come in order.
    """
    if not path:
        return value
    now = F.from_json(json_, "map<string,variant>")
    inner = set_nested(F.coalesce(F.to_json(F.try_element_at(now, F.lit(path[0]))), F.lit("{}")), path[1:], value)
    rest = F.coalesce(F.map_filter(now, lambda k, _: k != path[0]), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    return F.to_json(F.try_parse_json(F.to_json(F.map_concat(rest, F.create_map(F.lit(path[0]), F.try_parse_json(inner))))))


_SUITES = "$.suites"


def _parts(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def suites_of(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, path, file, suite)``: every suite of nested reports, however deep; path joins titles with ' > '.

    A report is parsed once. Each round takes the suites inside those of the round before, which are settled, until there are none.
    """
    level = reports.select(F.col(id_col).alias("id"), F.lit("").alias("up"), F.explode(_parts(F.try_parse_json(json_col), _SUITES)).alias("suite"))
    found = None
    while True:
        title = F.coalesce(_text(F.col("suite"), "$.title"), F.lit(""))
        path = F.when(F.col("up") == "", title).when(title == "", F.col("up")).otherwise(F.concat("up", F.lit(" > "), title))
        here = settled(level.select("id", path.alias("path"), F.coalesce(_text(F.col("suite"), "$.file"), F.lit("")).alias("file"), "suite"))
        if here.isEmpty():
            return found if found is not None else here
        found = here if found is None else found.union(here)
        level = here.select("id", F.col("path").alias("up"), F.explode(_parts(F.col("suite"), _SUITES)).alias("suite"))


def _tests(suites: DataFrame) -> DataFrame:
    """``(id, path, file, title, ok, test)`` of suites."""
    specs = suites.select("id", "path", "file", F.explode(_parts(F.col("suite"), "$.specs")).alias("spec"))
    return specs.select("id", "path", "file", _text(F.col("spec"), "$.title").alias("title"), F.try_variant_get("spec", "$.ok", "boolean").alias("ok"), F.explode(_parts(F.col("spec"), "$.tests")).alias("test"))


def flatten_reports(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, path, title, project, status, duration, expected, ok, error)``: a row per result of a nested report of any depth."""
    tests = _tests(suites_of(reports, id_col, json_col))
    results = tests.withColumn("r", F.explode(_parts(F.col("test"), "$.results")))
    r, t = F.col("r"), F.col("test")
    error = F.coalesce(_text(r, "$.errors[0].message"), _text(r, "$.errors[0]"), _text(r, "$.errors.message"), _text(r, "$.error[0].message"), _text(r, "$.error.message"))
    return results.select(
        "id", "path", "title", F.coalesce(_text(t, "$.projectName"), F.lit("default")).alias("project"), F.coalesce(_text(r, "$.status"), F.lit("unknown")).alias("status"),
        F.coalesce(F.try_variant_get(r, "$.duration", "double"), F.lit(0.0)).alias("duration"), F.coalesce(_text(t, "$.expectedStatus"), F.lit("passed")).alias("expected"), F.coalesce("ok", F.lit(True)).alias("ok"), error.alias("error"),
    )


def tests_of_reports(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, name, file, project, status, expected, ok, duration, error)``: a row per test of a nested report, by its first result."""
    tests = _tests(suites_of(reports, id_col, json_col))
    t = F.col("test")
    none = F.size(_parts(t, "$.results")) == 0
    status = _text(t, "$.results[0].status")
    ok = F.when(none, True).otherwise(F.coalesce(F.try_variant_get(t, "$.ok", "boolean"), status == "expected", F.lit(False)))
    return tests.select(
        "id", F.coalesce("title", F.lit("")).alias("name"), "file", F.coalesce(_text(t, "$.projectName"), F.lit("")).alias("project"), F.coalesce(status, _text(t, "$.status"), F.lit("unknown")).alias("status"),
        F.coalesce(_text(t, "$.expectedStatus"), F.lit("passed")).alias("expected"), ok.alias("ok"), F.coalesce(F.try_variant_get(t, "$.results[0].duration", "double"), F.lit(0.0)).alias("duration"), _text(t, "$.results[0].error.message").alias("error"),
    )


def top_tests(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, name, passed)``: a row per test of the outermost suites; a test passes if it says ``ok``."""
    suites = reports.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.lit("").alias("file"), F.explode(_parts(F.try_parse_json(json_col), _SUITES)).alias("suite"))
    return _tests(suites).select("id", F.coalesce(_text(F.col("test"), "$.title"), F.lit("")).alias("name"), F.coalesce(F.try_variant_get("test", "$.ok", "boolean"), F.lit(False)).alias("passed"))


def result_lines(logs: DataFrame, id_col: str, text_col: str, keep: int = 10) -> DataFrame:
    """``(id, passed, failed, skipped, samples)`` of lines of test output: the first mark that fits counts."""
    lines = F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: x != "")
    kind = lambda x: F.when(x.rlike("✓|PASS|passed"), "passed").when(x.rlike("✗|✘|FAIL|failed"), "failed").when(x.rlike("SKIP|skipped"), "skipped")
    marked = F.filter(F.transform(lines, lambda x: F.struct(kind(x).alias("k"), x.alias("line"))), lambda s: s["k"].isNotNull())
    rows = logs.select(F.col(id_col).alias("id"), marked.alias("m"))
    count = lambda k: F.size(F.filter("m", lambda s: s["k"] == k)).alias(k)
    return rows.select("id", count("passed"), count("failed"), count("skipped"), F.transform(F.slice("m", 1, keep), lambda s: s["line"]).alias("samples"))


def diff_ranges(diffs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, file, start, stop)`` of the new side's ranges of unified diffs; deletions only have none.

    The current file is the last one named above a hunk, by a window over the lines of one diff.
    """
    lines = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    file = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1))
    hunk = lambda i: F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", i)
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    here = lines.filter("line like '+++ %' or line like '@@ %'").withColumn("file", F.last(file, ignorenulls=True).over(w))
    size = F.when(hunk(2) == "", F.lit(1)).otherwise(hunk(2).try_cast("int"))
    found = here.filter(hunk(1) != "").select("id", "file", hunk(1).cast("int").alias("start"), size.alias("size"))
    return found.filter("size > 0").select("id", "file", "start", (F.col("start") + F.col("size") - 1).alias("stop"))


def endpoints(specs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, path, method, tag, name, place)`` of an OpenAPI document's operations, in the order of methods.

    tag: the first one or Other; name: the summary, or method and last part of the path.
    """
    paths = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json(json_col), "$.paths", "variant")), "map<string,map<string,variant>>")
    each = specs.select(F.col(id_col).alias("id"), F.explode(paths).alias("path", "methods")).select("id", "path", F.explode("methods").alias("method", "op"))
    method = F.upper("method")
    known = F.when(method == "GET", 0).when(method == "POST", 1).when(method == "PUT", 2).when(method == "PATCH", 3).when(method == "DELETE", 4).otherwise(99)
    last = F.element_at(F.filter(F.split("path", "/"), lambda p: ~p.rlike(r"^$|^\{")), -1)
    name = F.coalesce(F.try_variant_get("op", "$.summary", "string"), F.concat_ws(" ", method, last))
    return each.filter(~F.lower("method").isin("parameters", "summary", "description", "servers")).select("id", "path", method.alias("method"), F.coalesce(F.try_variant_get("op", "$.tags[0]", "string"), F.lit("Other")).alias("tag"), name.alias("name"), known.alias("place"))


def features_text(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Cases as the text of a feature file, one row each: a title, then fields as comments."""
    lines = [F.concat(F.lit(f"  # {f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields[1:]]
    return cases.select(F.concat_ws("\n", F.concat(F.lit("Feature: "), F.col(fields[0]).cast("string")), *lines).alias("value"))
