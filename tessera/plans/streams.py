"""What streams compute, over tables: windows of events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import diagnosis as D, ttl
from tessera.plans.diagnosis import _LOGS, logs
from tessera.plans.registry import query
from tessera.sources.tables import table
from tessera.streaming import state
from tessera.streaming.limits import counts_per_window


@query("requests_in_last_hour", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events""")
def requests_in_last_hour(spark, sf_dir):
    """How many requests a limiter without feedback would see: an upper bound of the stateful one.

    Events are dealt to their hour and the next one, so a window holds two hours of a user, not all of a user's history.
    """
    t, hour = F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000
    own = F.floor(t / hour)
    dealt = table(spark, sf_dir, "events").select("event_id", "user_id", t.alias("t"), own.alias("own"), F.explode(F.array(own, own + 1)).alias("bucket"))
    w = Window.partitionBy("user_id", "bucket").orderBy("t").rangeBetween(-hour, 0)
    return dealt.withColumn("n", F.count("*").over(w)).filter("own = bucket").select("event_id", "n")


@query("events_per_window", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_per_window(spark, sf_dir):
    rows = counts_per_window(table(spark, sf_dir, "events"), "ts", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("rollup_cube", """
SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def rollup_cube(spark, sf_dir):
    """An extension: counts by each combination of two dimensions."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("cached_values", f"""
WITH RECURSIVE {_LOGS}, l AS (SELECT log_id, sha256(concat_ws('|', status_code, method, endpoint, error_message)) AS key, epoch_us(created_at) AS t FROM logs),
misses(key, t) AS (SELECT key, min(t) FROM l GROUP BY 1 UNION ALL SELECT m.key, min(l.t) FROM misses m JOIN l ON l.key = m.key AND l.t >= m.t + 86400000000 GROUP BY 1, m.t),
stored AS (SELECT m.key, m.t, min(log_id) AS log_id FROM misses m JOIN l USING (key, t) GROUP BY 1, 2)
SELECT l.log_id AS id, s.log_id <> l.log_id AS hit, s.log_id::VARCHAR AS value FROM l ASOF JOIN stored s ON s.key = l.key AND l.t >= s.t""")
def cached_values(spark, sf_dir):
    """Diagnoses by a cache of a day: which log each log's diagnosis was made for."""
    keyed = logs(spark, sf_dir).withColumn("key", D.cache_key(F.col("status_code"), F.col("method"), F.col("endpoint"), F.col("error_message")))
    return ttl.cached(keyed, "key", "created_at", "log_id", "log_id").select("id", "hit", "value")


@query("unread_reports", """
WITH e AS (SELECT event_id, user_id, event_type, ts FROM events), r AS (SELECT * FROM e WHERE event_type IN ('signup', 'view')),
acks AS (SELECT a.user_id, a.ts, a.event_id, r.event_id AS report FROM e a ASOF JOIN r ON r.user_id = a.user_id AND a.ts >= r.ts WHERE a.event_type = 'click'),
open AS (SELECT p.user_id, p.event_id, r.event_id AS report, r.ts FROM e p JOIN r ON r.user_id = p.user_id AND r.ts < p.ts WHERE p.event_type = 'purchase' AND epoch_us(p.ts) % 5 = 0
  AND NOT EXISTS (SELECT 1 FROM acks a WHERE a.report = r.event_id AND a.ts < p.ts))
SELECT event_id AS id, row_number() OVER (PARTITION BY event_id ORDER BY ts) - 1 AS nth, 'r' || report AS report FROM open""")
def unread_reports(spark, sf_dir):
    """Users as projects: sign-ups and views are reports, a click acknowledges the last one, some purchases ask for what is unread."""
    kind = F.when(F.col("event_type").isin("signup", "view"), "report").when(F.col("event_type") == "click", "ack").when((F.col("event_type") == "purchase") & (F.unix_micros(F.col("ts").cast("timestamp")) % 5 == 0), "replay")
    own = F.when(F.col("event_type").isin("signup", "view"), F.concat(F.lit("r"), F.col("event_id").cast("string")))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), last.alias("report")).filter("kind is not null")
    return state.unread(rows, "user_id", "ts", "event_id", "kind", "report").select("id", "nth", "report")
