"""Scalar functions, small filters and projections, and file sources written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.operators import changes, diagnosis as D, predicates as P, scenario as S
from tessera.operators.rounds import folder
from tessera.plans.diagnosis import _CLASSIFIED, logs
from tessera.plans.registry import query
from tessera.sources import files
from tessera.sources.tables import table


@query("path_parts", """
WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'src/' || lower(p_type) || '/' || p_name || '.py' WHEN 1 THEN p_name ELSE 'src/' || p_name END AS path FROM part)
SELECT id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, regexp_extract(path, '[^/]*$') AS name, CASE id % 3 WHEN 0 THEN split_part(path, '/', 2) WHEN 1 THEN '' ELSE 'src' END AS last FROM p""")
def path_parts(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_name", F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("src/"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.dirname(path).alias("folder"), C.basename(path).alias("name"), C.last_folder(path).alias("last"))


@query("slugs", "SELECT doc_id, regexp_replace(substr(text, 1, 60), '[^\\p{L}\\p{M}\\p{N}_\\-]+', '-', 'g') AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.slug(F.substring("text", 1, 60)).alias("slug"))


@query("iso_times", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts - CASE event_id % 4 WHEN 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def iso_times(spark, sf_dir):
    """Times with Z, without zone, with an offset, and broken ones."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    given = F.when(kind == 0, F.concat(text, F.lit("Z"))).when(kind == 1, text).when(kind == 2, F.concat(text, F.lit("+02:00"))).otherwise(F.concat(F.lit("at "), text))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(C.iso_time(given), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("durations_ms", """
SELECT user_id, max(ms) AS longest, min(ms) AS shortest FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000 AS ms FROM events) WHERE ms IS NOT NULL GROUP BY 1""")
def durations_ms(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", before.alias("before")).filter("before is not null")
    return rows.groupBy("user_id").agg(F.max(C.milliseconds(F.col("before"), F.col("ts"))).alias("longest"), F.min(C.milliseconds(F.col("before"), F.col("ts"))).alias("shortest"))


@query("range_or_all", """
WITH w AS (SELECT * FROM (VALUES ('7d'), ('30d'), ('90d'), ('all')) t(period)), m AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT period, count(*) AS n FROM w, m, orders WHERE o_orderdate >= CASE period WHEN '7d' THEN now - INTERVAL 7 DAY WHEN '30d' THEN now - INTERVAL 30 DAY WHEN '90d' THEN now - INTERVAL 90 DAY ELSE TIMESTAMP '2020-01-01' - INTERVAL 20 YEAR END GROUP BY 1""")
def range_or_all(spark, sf_dir):
    """Orders in relative ranges; any other name means since 2020-01-01, here moved back by the twenty years that the data are older."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    start = {p: C.range_start(F.lit(p), now) for p in ("7d", "30d", "90d")} | {"all": C.range_start(F.lit("all"), now) - F.make_interval(years=F.lit(20))}
    within = F.array_compact(F.array(*[F.when(F.col("o_orderdate") >= s, F.lit(p)) for p, s in start.items()]))
    return orders.select(F.explode(within).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


@query("enum_filter", "SELECT 'F' AS asked, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'nonsense', count(*) FROM orders UNION ALL SELECT '', count(*) FROM orders")
def enum_filter(spark, sf_dir):
    """A known value filters; an unknown one, or none, does not."""
    orders = table(spark, sf_dir, "orders")
    parts = [P.enum_where_known(orders, "o_orderstatus", v, ("F", "O", "P")).agg(F.lit(v).alias("asked"), F.count("*").alias("n")) for v in ("F", "nonsense", "")]
    return changes.union_all(parts, ["asked", "n"])


@query("full_or_short", """
SELECT o_orderkey AS id, o_orderstatus AS state, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'P' THEN '{"customer":' || o_custkey || ',"total":' || round(o_totalprice)::BIGINT || '}' END AS details FROM orders""")
def full_or_short(spark, sf_dir):
    """Rows with all that belongs to them as a struct, or the short form, in which it is null."""
    full = F.col("o_orderstatus") == "P"
    rows = P.projected(table(spark, sf_dir, "orders"), {"id": F.col("o_orderkey"), "state": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, {"customer": F.col("o_custkey"), "total": F.round("o_totalprice").cast("long")}, full)
    return rows.withColumn("details", F.to_json("details"))


@query("count_serial", "SELECT c_mktsegment AS project, 'TR-' || (count(*) + 1) AS next FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 1")
def count_serial(spark, sf_dir):
    """Numbers by count, which deletes make come again."""
    return P.count_serial(table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3"), F.col("c_mktsegment").alias("project"), "TR-")


@query("findings_in_order", f"WITH {_CLASSIFIED} SELECT log_id, classifier, confidence FROM found ORDER BY classifier <> 'rule', confidence DESC, log_id")
def findings_in_order(spark, sf_dir):
    """Findings by rules before fallbacks, the surest first."""
    found = D.classify(logs(spark, sf_dir))
    return found.orderBy(*D.rules_first(found)).select("log_id", "classifier", "confidence")


@query("json_merge", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k') || '&type=' || event_type WHEN 1 THEN 'k=9' ELSE 'k=' || json_extract_string(props, '$.k') END AS merged FROM events""")
def json_merge(spark, sf_dir):
    """A map merged with another, replaced by it, and left alone."""
    own = F.from_json("props", "map<string,string>")
    kind = F.col("event_id") % 3
    merged = F.when(kind == 0, S.laid_over(own, F.create_map(F.lit("type"), F.col("event_type")))).when(kind == 1, changes.edit_map(own, "merge", {"k": "9"})).otherwise(changes.edit_map(own, "remove", {"type": ""}))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), "&").alias("merged"))


@query("transforms", """
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN upper(s_name) WHEN 1 THEN lower(s_name) WHEN 2 THEN length(s_name)::VARCHAR WHEN 3 THEN substr(s_name, 1, 8) WHEN 4 THEN s_name ELSE s_name END AS value FROM supplier""")
def transforms(spark, sf_dir):
    """Named transforms; int of a text that is none, and an unknown name, leave the value."""
    name = F.element_at(F.array(*map(F.lit, ("upper", "lower", "length", "first8", "int", "import os"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.transformed(F.col("s_name"), name).alias("value"))


@query("documents_round_trip", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'view') AND value >= 50 ORDER BY value DESC, event_id LIMIT 20 OFFSET 5")
def documents_round_trip(spark, sf_dir):
    """Documents written as JSON by type, and read back with a filter, an order and a page."""
    path = f"{folder(spark)}/reports-{uuid.uuid4().hex}"
    files.write_reports(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, ["event_type"])
    found = files.documents(spark, path, "event_id long, event_type string, value double", F.col("event_type").isin("error", "view") & (F.col("value") >= 50))
    return found.orderBy(F.desc("value"), "event_id").offset(5).limit(20).select("event_id", "event_type", "value")


@query("trailing_json", """
SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 4 <> 3 THEN '{"k": ' || json_extract_string(props, '$.k') || '}' END AS json FROM events""")
def trailing_json(spark, sf_dir):
    """The last JSON object in outputs, after others, broken ones and braces; none where all is broken."""
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit('start {"a": 1} then '), "props", F.lit("\ndone"))).when(kind == 1, F.col("props")).when(kind == 2, F.concat(F.lit("{ broken { "), "props", F.lit(" } tail"))).otherwise("no { json } here")
    return files.trailing_json(table(spark, sf_dir, "events").select("event_id", text.alias("out")), "event_id", "out")


@query("replayed_rate_limit", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, t, true AS admitted, [t] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.t, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, e.t) ELSE k END FROM (SELECT *, 1 AS one FROM e) e JOIN w ON w.user_id = e.user_id AND e.n = w.n + 1, LATERAL (SELECT list_filter(w.kept, lambda x: x > e.t - 86400) AS k) l)
SELECT user_id::VARCHAR AS key, event_id AS id, admitted FROM w""")
def replayed_rate_limit(spark, sf_dir):
    """At most three requests of a user in a day, over a table as one batch; the stream's operator gives the same rows."""
    from tessera.streaming.limits import rate_limited_batch

    return rate_limited_batch(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400, 3)
