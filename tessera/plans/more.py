"""Merged stores, version choice, samples, incremental plans and the reach of routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes as C, graph as G, joins as J, scenario as S
from tessera.operators.predicates import page
from tessera.plans.graph import _EDGES, _NODES, _edges, _nodes
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("union_of_stores", """
SELECT 'log' AS store, event_id AS id, event_type AS status FROM events WHERE event_type = 'error' UNION ALL SELECT 'step', o_orderkey, lower(o_orderstatus) FROM orders WHERE o_orderstatus = 'P'""")
def union_of_stores(spark, sf_dir):
    """Failures of two stores in one schema."""
    logs = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("log").alias("store"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    steps = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit("step").alias("store"), F.col("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("status"))
    return C.union_all([logs, steps], ["store", "id", "status"])


@query("merged_page", """
SELECT * FROM (SELECT 'api' AS kind, event_id AS id, ts AS stamp FROM events WHERE event_type = 'error' UNION ALL SELECT 'web', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P') ORDER BY stamp DESC, kind, id LIMIT 30 OFFSET 30""")
def merged_page(spark, sf_dir):
    """A page of two kinds of reports, newest first."""
    api = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("api").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("stamp"))
    web = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit("web").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp"))
    return page(C.union_all([api, web], ["kind", "id", "stamp"]), [F.desc("stamp"), F.col("kind"), F.col("id")], 2, 30)


@query("version_resolution", """
WITH latest AS (SELECT o_orderpriority AS repo, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS v FROM orders GROUP BY 1), wanted AS (SELECT s_suppkey AS id, 1 + s_suppkey % 5 AS p, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS v FROM supplier)
SELECT w.id, coalesce(w.v, l.v) AS version FROM wanted w JOIN latest l ON starts_with(l.repo, w.p::VARCHAR || '-')""")
def version_resolution(spark, sf_dir):
    """The version asked for, or else the latest."""
    versions = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("p"), F.col("o_orderdate").alias("analyzed_at"), F.col("o_orderkey").alias("version"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (1 + F.col("s_suppkey") % 5).alias("p"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).alias("v"))
    return wanted.join(G.latest_version(versions, "p"), "p").select("id", F.coalesce("v", "version").alias("version"))


@query("graph_sample", f"""
WITH {_EDGES}, {_NODES}, s AS (SELECT id FROM nodes ORDER BY start, id LIMIT 200)
SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)""")
def graph_sample(spark, sf_dir):
    """The edges inside a sample of nodes for display; none dangles."""
    sample = _nodes(spark, sf_dir).orderBy("start", "id").limit(200).select("id")
    return J.induced(_edges(spark, sf_dir), sample, "id")


@query("route_impact", f"""
WITH {_EDGES}, {_NODES}, r AS (SELECT id, file FROM nodes WHERE type = 'route' AND name ILIKE '%7%'), t AS (SELECT r.id, target AS other FROM edges JOIN r ON source = r.id UNION SELECT r.id, source FROM edges JOIN r ON target = r.id),
near AS (SELECT r.id, count(*) AS handlers FROM r JOIN nodes s ON s.file ILIKE r.file || '%' AND s.type = 'function' GROUP BY 1)
SELECT r.id, (SELECT count(*) FROM t WHERE t.id = r.id) AS touching, coalesce(any_value(handlers), 0) AS handlers FROM r LEFT JOIN near USING (id) GROUP BY r.id""")
def route_impact(spark, sf_dir):
    """Routes by name, the nodes their edges touch and the handlers whose file begins with the route's folder."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir, False)
    found = nodes.filter((F.col("type") == "route") & F.col("name").ilike("%7%")).select("id", "file")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    # ids outside the routes' range can't be routes: ends of other kinds aren't shuffled at all
    low, high = found.agg(F.min("id"), F.max("id")).first()
    touching = both.filter(F.col("id").between(low, high)).join(found.select("id"), "id", "left_semi").groupBy("id", "other").count().groupBy("id").agg(F.count("*").alias("touching"))
    files = nodes.filter("type = 'function'").groupBy(F.col("file").alias("of")).agg(F.count("*").alias("n"))
    sizes = J.prefix_counts(found.select("file").distinct(), "file", files, "of", "n").withColumnRenamed("total", "handlers")
    return found.join(touching, "id", "left").join(sizes, "file", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("touching", "handlers")])


@query("incremental_plan", """
WITH a AS (SELECT o_custkey AS file, max(o_orderkey) AS h FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01' GROUP BY 1), b AS (SELECT o_custkey AS file, max(o_orderkey) AS h FROM orders WHERE o_custkey % 50 <> 1 GROUP BY 1),
c AS (SELECT CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.file = b.file WHERE a.h IS DISTINCT FROM b.h)
SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'modified') AS modified,
  CASE WHEN count(*) > 50 THEN 'full' ELSE 'incremental' END AS mode, 5 * count(*) FILTER (WHERE change = 'added') + 3 * count(*) FILTER (WHERE change = 'removed') + 3 * count(*) FILTER (WHERE change = 'modified') AS estimate FROM c""")
def incremental_plan(spark, sf_dir):
    """What changed between two scans of files, and whether to build anew (more than 50 files)."""
    orders = table(spark, sf_dir, "orders")
    scan = lambda rows: rows.groupBy(F.col("o_custkey").alias("file")).agg(F.max("o_orderkey").alias("h"))
    changes = J.version_diff(scan(orders.filter("o_orderdate < timestamp_ntz '2000-06-01'")), scan(orders.filter("o_custkey % 50 <> 1")), ["file"], ["h"])
    n = {c: F.count_if(F.col("change") == c) for c in ("added", "removed", "modified")}
    return changes.agg(*[v.alias(k) for k, v in n.items()], F.when(F.count("*") > 50, "full").otherwise("incremental").alias("mode"), (5 * n["added"] + 3 * n["removed"] + 3 * n["modified"]).alias("estimate"))


@query("request_resolution", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'PUT' WHEN o_orderstatus = 'P' THEN 'GET' ELSE 'POST' END || ' /customers/' || o_custkey || '/orders' AS line,
  'limit=' || CASE WHEN o_orderkey % 3 = 0 THEN '5' ELSE '20' END || CASE WHEN o_orderkey % 5 = 0 THEN '&trace=' || o_orderstatus ELSE '' END AS params,
  'x-trace=' || CASE WHEN o_orderkey % 5 = 1 THEN 'on-' || o_orderkey ELSE 'off' END AS headers,
  CASE WHEN o_orderkey % 7 = 0 THEN 'mapped {{prio}}' ELSE '{"id":' || o_orderkey || ',"note":"for ' || o_orderpriority || '","raw":"{{none}}"}' END AS body FROM orders""")
def request_resolution(spark, sf_dir):
    """A request from its endpoint, default parameters, overrides, mappings and templates. Values are filled in once."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    variables = F.create_map(F.lit("prio"), F.col("o_orderpriority"), F.lit("id"), text, F.lit("brace"), F.lit("{{prio}}"))
    path = S.path_parameters(F.lit("/customers/{customer}/orders"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")))
    defaults = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(n).alias("name"), F.lit(d).alias("default")) for p, n, d in (("query", "limit", "20"), ("header", "x-trace", "off"), ("path", "customer", None))])
    of = lambda condition, k, v: F.when(condition, F.create_map(F.lit(k), v))
    override = F.struct(F.when(key % 4 == 1, "PUT").alias("method"), F.lit(None).cast("string").alias("url"), of(key % 3 == 0, "limit", F.lit("5")).alias("params"), F.lit('{"id":{{id}},"note":"for {{prio}}","raw":"{{none}}"}').alias("body"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    mappings = F.map_concat(F.coalesce(of(key % 5 == 0, "params.trace", F.col("o_orderstatus")), none), F.coalesce(of(key % 7 == 0, "body", F.lit("mapped {{brace}}")), none))
    method = F.when(F.col("o_orderstatus") == "P", "GET")
    request = S.resolved(method, path, defaults, override, of(key % 5 == 1, "x-trace", F.lit("on-{{id}}")), mappings, variables)
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", request.alias("r"))
    return rows.select("o_orderkey", F.concat_ws(" ", "r.method", "r.url").alias("line"), flat(F.col("r.params")).alias("params"), flat(F.col("r.headers")).alias("headers"), F.col("r.body").alias("body"))


@query("feature_export", "SELECT 'Feature: ' || p_name || chr(10) || '  # p_brand: ' || p_brand || chr(10) || '  # p_size: ' || p_size AS value FROM part")
def feature_export(spark, sf_dir):
    return S.features_text(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"])
