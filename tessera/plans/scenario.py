"""Scenario steps from lineitem and events, reports from conversations, diffs from suppliers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import json_paths, runs as R, scenario as S
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("template_substitute", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'GET /nation/' || s_nationkey || '/supplier/{{unknown}}?name=' || s_name WHEN 1 THEN '{{name}} {' || s_name || '} {{none}}{{' ELSE '{{ name }}' || s_name || s_nationkey || '}}' END AS url FROM supplier""")
def template_substitute(spark, sf_dir):
    """Unknown and null names stay; a value that looks like a template is not filled in again."""
    variables = F.create_map(F.lit("nation.id"), F.col("s_nationkey").cast("string"), F.lit("name"), F.col("s_name"), F.lit("none"), F.lit(None).cast("string"), F.lit("self"), F.lit("{{name}}"))
    text = F.element_at(F.array(*map(F.lit, ("GET /nation/{{nation.id}}/supplier/{{unknown}}?name={{name}}", "{{self}} {{{name}}} {{none}}{{", "{{ name }}{{name}}{{nation.id}}}}"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.substitute(text, variables).alias("url"))


@query("path_parameters", "SELECT o_orderkey, '/customers/' || o_custkey || '/orders/' || o_orderkey AS path FROM orders")
def path_parameters(spark, sf_dir):
    values = F.create_map(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("o"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.path_parameters(F.lit("/customers/{c}/orders/{o}"), values).alias("path"))


@query("mapping_sources", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN upper('static-' || event_type) END AS value FROM events""")
def mapping_sources(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("previous_response", "variable", "static", "function"))), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.when(kind == "previous_response", "$.k").otherwise("user")
    value = S.mapped(kind, F.col("props"), path, F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.concat(F.lit("static-"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.transformed(value, F.when(kind == "static", "upper").otherwise("no such")).alias("value"))


@query("json_path_first", """
SELECT l_orderkey, l_partkey::VARCHAR AS part FROM lineitem WHERE l_quantity > 45
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def json_path_first(spark, sf_dir):
    """Of each order, as a nested body, the part of its first line of a large quantity: a descent, then a comparison."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.struct(F.col("l_quantity").alias("quantity")).alias("amount"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    bodies = orders.select("l_orderkey", F.to_json(F.struct(F.struct("lines").alias("order"))).alias("body"))
    found = json_paths.first(bodies, "$..lines[?(@.amount.quantity > 45)].part", key="l_orderkey")
    return found.select(F.col("key").alias("l_orderkey"), F.col("value").alias("part"))


@query("json_path_wildcard", """
WITH m AS (SELECT event_id, unnest([json_extract_string(props, '$.k'), event_type, user_id::VARCHAR]) AS value, unnest([0, 1, 2]) AS nth FROM events)
SELECT value, nth, count(*) AS n FROM m GROUP BY value, nth""")
def json_path_wildcard(spark, sf_dir):
    """How often each value stands at each place among all values of two objects of an event's body."""
    body = F.concat(F.lit('{"a":{"p":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(',"b":'), F.to_json(F.struct(F.col("event_type").alias("v"))), F.lit('},"c":['), F.coalesce(F.col("user_id").cast("string"), F.lit("null")), F.lit("]}"))
    events = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    leaves = json_paths.matches(events, "$..*", key="event_id").filter(~F.col("text").startswith("{") & ~F.col("text").startswith("["))
    plain = F.when(F.col("text") != "null", F.try_variant_get(F.try_parse_json("text"), F.lit("$"), "string"))
    where = F.when(F.col("at")[0] == -1, None).when((F.size("at") == 3) & (F.col("at")[0] == 0), 0).when(F.size("at") == 4, 1).otherwise(2)
    return leaves.select(plain.alias("value"), where.alias("nth")).groupBy("value", "nth").agg(F.count("*").alias("n"))


@query("assertion_eval", """
WITH s AS (SELECT event_id, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, status = 200 AND event_type <> 'click' AND k > 9 AS passed,
CASE WHEN status <> 200 THEN 'status  eq 200 but was ' || status WHEN event_type = 'click' THEN 'header x-type ne click but was click' WHEN k <= 9 THEN 'jsonpath $.k gt 9 but was ' || k END AS first_error FROM s""")
def assertion_eval(spark, sf_dir):
    checks = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("path"), F.lit(o).alias("operator"), F.lit(e).alias("expected")) for t, p, o, e in (("status", None, "eq", "200"), ("header", "x-type", "ne", "click"), ("jsonpath", "$.k", "gt", "9"))])
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    steps = table(spark, sf_dir, "events").select("event_id", status.alias("status_code"), F.create_map(F.lit("x-type"), F.col("event_type")).alias("headers"), F.col("props").alias("body"), checks.alias("assertions"))
    return S.assertions(steps).select("event_id", "passed", "first_error")


@query("run_stop_rule", """
WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status, event_id % 5 <> 0 AS goes_on FROM events),
stop AS (SELECT user_id, min(n) AS stop_at FROM s WHERE status = 'failed' AND NOT goes_on GROUP BY 1)
SELECT event_id, CASE WHEN n > stop_at THEN 'skipped' ELSE status END AS status FROM s LEFT JOIN stop USING (user_id)""")
def run_stop_rule(spark, sf_dir):
    from tessera.operators.aggregates import renumbered

    rows = renumbered(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "step_order")
    steps = rows.select("event_id", F.col("user_id").alias("run_id"), "step_order", F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"), (F.col("event_id") % 5 != 0).alias("continue_on_failure"))
    return S.stopped(steps).select("event_id", "status")


_NAMES = ("Remove part ", "修改 part ", "create part ", "part ", "list of new part ", "GET part ", "delete and get part ", "edit, then remove ", "新建 part ", "查询并删除 part ", "update ")


@query("method_inference", f"""
WITH n AS (SELECT p_partkey, {list(_NAMES)!r}[1 + p_size % {len(_NAMES)}] || p_name AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '创建|新建|添加|create|add|new') THEN 'POST' WHEN regexp_matches(name, '获取|查询|get|fetch|list') THEN 'GET' WHEN regexp_matches(name, '更新|修改|update|edit|modify') THEN 'PUT' WHEN regexp_matches(name, '删除|delete|remove') THEN 'DELETE' ELSE 'POST' END AS method FROM n""")
def method_inference(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_size") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.method_of(F.concat(name, F.col("p_name"))).alias("method"))


@query("endpoint_of_test", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/' || event_type WHEN 1 THEN event_type ELSE 'get /' || event_type END AS endpoint, CASE event_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'PATCH' ELSE 'GET' END AS method FROM events""")
def endpoint_of_test(spark, sf_dir):
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("POST  /"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("PATCH "), "event_type")).otherwise(F.concat(F.lit("get /"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.endpoint_of(name).alias("e")).select("event_id", "e.*")


@query("nested_value_set", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":{"b":"' || event_type || '","keep":1},"k":' || json_extract_string(props, '$.k') || '}' WHEN 1 THEN '{"a":{"b":"' || event_type || '"},"k":' || json_extract_string(props, '$.k') || '}' ELSE '{"a":{"b":"' || event_type || '"},"k":' || json_extract_string(props, '$.k') || ',"z":[1,2]}' END AS body FROM events""")
def nested_value_set(spark, sf_dir):
    """A value set at a path of a JSON body; what is in the way and no object is replaced."""
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "a": {"keep": 1}}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"k": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"z":[1,2],"a":5,"k":'), k, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", S.set_nested(body, ["a", "b"], F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("body"))


_DEPTH = 20
_PLACED = f"""placed AS (SELECT *, turn % {_DEPTH} AS level FROM conversations WHERE conv_id IS NOT NULL),
deep AS (SELECT conv_id, max(level) AS top FROM placed GROUP BY 1),
rows AS (SELECT conv_id AS id, 'conv ' || conv_id || array_to_string(list_transform(range(1, level + 1), lambda i: ' > level ' || i), '') AS path, role || ' ' || turn AS title, CASE WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'passed' END AS status, length(text)::DOUBLE AS duration, turn, level FROM placed)"""


def _reports(spark, sf_dir):
    """Reports as deep as 20 suites: a turn is a spec of the suite of level turn % 20; a conversation's suites lie in each other."""
    result = F.struct(F.when(F.length("text") % 3 == 0, "failed").otherwise("passed").alias("status"), F.length("text").alias("duration"), F.when(F.length("text") % 3 == 0, F.array(F.struct(F.concat(F.lit("wrong "), "role").alias("message")))).alias("errors"))
    test = F.struct(F.when(F.col("turn") % 2 == 0, "p").alias("projectName"), F.when(F.col("turn") % 4 != 3, F.array(result)).alias("results"), (F.col("turn") % 5 == 0).alias("ok"), F.concat_ws(" ", F.lit("test"), F.col("turn").cast("string")).alias("title"))
    spec = F.struct(F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.array(test).alias("tests"))
    level = F.col("turn") % _DEPTH
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    specs = turns.groupBy("conv_id", level.alias("level")).agg(F.to_json(F.collect_list(spec)).alias("specs"))
    maps = specs.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "specs"))).alias("m"), F.max("level").alias("top"))
    title = lambda i: F.when(i == 0, F.concat(F.lit("conv "), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("level "), i.cast("string")))
    inside = lambda now, i: F.concat(F.lit('{"title":"'), title(i), F.lit('","file":"f'), i.cast("string"), F.lit('","specs":'), F.coalesce(F.try_element_at("m", i), F.lit("[]")), F.lit(',"suites":['), now, F.lit("]}"))
    nested = F.aggregate(F.sequence(F.col("top"), F.lit(0).cast(maps.schema["top"].dataType), F.lit(-1).cast(maps.schema["top"].dataType)), F.lit(""), inside)
    return maps.select("conv_id", F.concat(F.lit('{"suites":['), nested, F.lit("]}")).alias("json"))


@query("report_flatten", f"""WITH {_PLACED} SELECT id, path, title, CASE WHEN turn % 2 = 0 THEN 'p' ELSE 'default' END AS project, status, duration, 'passed' AS expected, true AS ok, CASE WHEN status = 'failed' THEN 'wrong ' || split_part(title, ' ', 1) END AS error FROM rows WHERE turn % 4 <> 3""")
def report_flatten(spark, sf_dir):
    """Reports of up to 20 levels, built from the turns of a conversation, and flattened again."""
    return S.flatten_reports(_reports(spark, sf_dir), "conv_id", "json")


@query("report_tests", f"""
WITH {_PLACED} SELECT id, title AS name, 'f' || level AS file, CASE WHEN turn % 2 = 0 THEN 'p' ELSE '' END AS project, CASE WHEN turn % 4 = 3 THEN 'unknown' ELSE status END AS status, 'passed' AS expected,
  CASE WHEN turn % 4 = 3 THEN true ELSE turn % 5 = 0 END AS ok, CASE WHEN turn % 4 = 3 THEN 0.0 ELSE duration END AS duration, NULL::VARCHAR AS error FROM rows""")
def report_tests(spark, sf_dir):
    """A row per test, with or without results."""
    return S.tests_of_reports(_reports(spark, sf_dir), "conv_id", "json")


@query("report_top_tests", f"""WITH {_PLACED} SELECT id, 'test ' || turn AS name, turn % 5 = 0 AS passed FROM rows WHERE level = 0""")
def report_top_tests(spark, sf_dir):
    return S.top_tests(_reports(spark, sf_dir), "conv_id", "json")


@query("diff_ranges", """
SELECT s_suppkey AS id, 'src/' || s_name || '.py' AS file, s_suppkey AS start, s_suppkey + s_nationkey AS stop FROM supplier UNION ALL SELECT s_suppkey, 'other.py', 7, 7 FROM supplier""")
def diff_ranges(spark, sf_dir):
    text = F.format_string("diff --git a/x b/x\n--- a/x\n+++ b/src/%s.py\n@@ -1,2 +%d,%d @@ def f\n-old\n+new\n@@ -9 +9,0 @@\n-gone\ndiff --git a/o b/o\n+++ b/other.py\n@@ -3 +7 @@\n+one", "s_name", "s_suppkey", F.col("s_nationkey") + 1)
    return S.diff_ranges(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("diff")), "s_suppkey", "diff")


@query("output_lines", """
WITH t AS (SELECT o_custkey AS id, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped FROM orders GROUP BY 1)
SELECT id, passed::INTEGER AS passed, failed::INTEGER AS failed, skipped::INTEGER AS skipped, least(10, passed + failed + skipped)::INTEGER AS n_samples FROM t""")
def output_lines(spark, sf_dir):
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "  ✓ order ").when(F.col("o_orderstatus") == "O", "  ✗ order ").otherwise("SKIP order "), F.col("o_orderkey").cast("string"))
    logs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws("\n", F.collect_list(line)).alias("out"))
    return S.result_lines(logs, "o_custkey", "out").select("id", "passed", "failed", "skipped", F.size("samples").alias("n_samples"))


@query("openapi_endpoints", """
SELECT p_partkey AS id, '/parts/' || p_partkey || '/{id}' AS path, m AS method, CASE m WHEN 'GET' THEN p_brand ELSE 'Other' END AS tag, CASE m WHEN 'GET' THEN 'Show ' || p_name ELSE m || ' ' || p_partkey END AS name, CASE m WHEN 'GET' THEN 0 ELSE 4 END AS place FROM part, (VALUES ('GET'), ('DELETE')) t(m)""")
def openapi_endpoints(spark, sf_dir):
    doc = F.format_string('{"openapi": "3.0", "paths": {"/parts/%d/{id}": {"parameters": [], "get": {"tags": ["%s", "x"], "summary": "Show %s"}, "delete": {"tags": []}}}}', "p_partkey", "p_brand", "p_name")
    text = F.regexp_replace(doc, '"parameters": \\[\\], ', "")
    return S.endpoints(table(spark, sf_dir, "part").select("p_partkey", text.alias("json")), "p_partkey", "json")


_VALUES = """e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
a AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN k END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER w AS seen FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(click, '{{click}}') || '-' || coalesce(seen, '{{view}}') AS pair FROM a),
c AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN pair END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS joined FROM b),
d AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'buy ' || k || ' of ' || coalesce(joined, 'nothing') || coalesce(click, '{{click}}') END AS bought FROM c),
f AS (SELECT *, last_value(bought IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_bought FROM d)"""


@query("run_variables", f"""
WITH {_VALUES} SELECT event_id, CASE event_type WHEN 'error' THEN 'GET /' || coalesce(last_bought, 'none yet') || '?' || coalesce(click, '{{{{click}}}}') WHEN 'purchase' THEN bought WHEN 'signup' THEN pair ELSE k END AS value FROM f""")
def run_variables(spark, sf_dir):
    """Users as runs, events as steps: clicks and views extract from their responses, sign-ups set a variable from both, purchases one from that, errors send a request with all."""
    events = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    steps = events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("props").alias("body"), kind)
    own = F.array(F.struct(kind.alias("name"), F.lit("$.k").alias("path")))
    extracts = R.extracted(steps.filter(kind.isin("click", "view")).withColumn("extractors", own))
    name = F.when(kind == "signup", "joined").when(kind == "purchase", "bought")
    text = F.when(kind == "signup", "{{click}}-{{view}}").when(kind == "purchase", F.concat(F.lit("buy "), k, F.lit(" of {{joined}}{{click}}"))).otherwise("GET /{{bought}}?{{click}}")
    row = lambda step, n, t: (F.col("user_id").alias("run"), step.alias("step"), F.lit(0).alias("nth"), n.alias("name"), t.alias("text"), F.lit(False).alias("fixed"))
    sets = events.filter(kind.isin("signup", "purchase", "error")).select(*row(F.col("event_id"), name, text))
    users = events.select("user_id").distinct()
    begin = [users.select(*row(F.lit(R.START).cast("long"), F.lit(n), F.lit(t))) for n, t in (("joined", "nothing"), ("bought", "none yet"))]
    found = R.resolved(extracts.unionByName(sets).unionByName(begin[0]).unionByName(begin[1]))
    return found.filter(F.col("step") != R.START).select(F.col("step").alias("event_id"), "value")


@query("previous_responses", """
WITH s AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT a.event_id, CASE WHEN a.event_id % 5 > 0 THEN json_extract_string(b.props, CASE a.event_id % 3 WHEN 0 THEN '$.none' ELSE '$.k' END) END AS value FROM s a LEFT JOIN s b ON b.user_id = a.user_id AND b.step = a.step - a.event_id % 5""")
def previous_responses(spark, sf_dir):
    """Mappings that take a value from the response of a step up to four before; one that names its own step, or a path that isn't there, gets none."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.col("props").alias("body"), F.row_number().over(order).alias("step"))
    path = F.when(F.col("event_id") % 3 == 0, "$.none").otherwise("$.k")
    mappings = steps.select("run", "step", "event_id", (F.col("step") - F.col("event_id") % 5).cast("int").alias("source_step"), path.alias("path"))
    return R.responses_before(mappings, steps).select("event_id", "value")
