"""Dashboards over executions: events stand in, with error as failed and value as the duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import aggregates as A
from tessera.operators.predicates import label, page
from tessera.plans.registry import query
from tessera.sources.tables import table

EXECUTIONS = "(SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS duration_ms, ts AS created_at, event_type FROM events)"


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"), "event_type")


def _with_status(status: str):
    return F.count_if(F.col("status") == status)


@query("dashboard_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed,
  round(coalesce(avg(duration_ms), 0), 1) AS avg_duration_ms,
  CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 1) ELSE 0.0 END AS pass_rate
FROM {EXECUTIONS}""")
def dashboard_summary(spark, sf_dir):
    totals = executions(spark, sf_dir).agg(F.count("*").alias("total"), _with_status("success").alias("passed"), _with_status("failed").alias("failed"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 1).alias("avg_duration_ms"))
    return totals.withColumn("pass_rate", A.pass_rate(F.col("passed"), F.col("total"), F.lit(0), F.lit(0)))


@query("dashboard_by_user", f"""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 4) AS pass_rate FROM {EXECUTIONS} GROUP BY user_id""")
def dashboard_by_user(spark, sf_dir):
    totals = executions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), _with_status("success").alias("passed"), _with_status("failed").alias("failed"))
    return totals.withColumn("pass_rate", A.rate(F.col("passed"), F.col("total"), 4))


@query("pass_rate_fallback", """
WITH tested AS (SELECT c_nationkey AS k, count(*) AS endpoints, count(*) FILTER (WHERE c_acctbal > 0) AS tested FROM customer GROUP BY 1),
runs AS (SELECT s_nationkey AS k, count(*) AS total, count(*) FILTER (WHERE s_acctbal > 0) AS passed FROM supplier GROUP BY 1)
SELECT k AS nationkey, CASE WHEN coalesce(total, 0) > 0 THEN round(100.0 * passed / total, 4) WHEN endpoints > 0 THEN round(100.0 * tested / endpoints, 4) ELSE 0.0 END AS pass_rate
FROM tested LEFT JOIN runs USING (k)""")
def pass_rate_fallback(spark, sf_dir):
    tested = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("endpoints"), F.count_if(F.col("c_acctbal") > 0).alias("tested"))
    runs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("total"), F.count_if(F.col("s_acctbal") > 0).alias("passed"))
    return tested.join(runs, "nationkey", "left").select("nationkey", A.pass_rate(F.col("passed"), F.coalesce("total", F.lit(0)), F.col("tested"), F.col("endpoints"), 4).alias("pass_rate"))


@query("recent_executions", f"SELECT event_id, user_id, status, duration_ms, created_at FROM {EXECUTIONS} ORDER BY created_at DESC, event_id LIMIT 20")
def recent_executions(spark, sf_dir):
    rows = executions(spark, sf_dir).select("event_id", "user_id", "status", "duration_ms", "created_at")
    return page(rows, [F.desc("created_at"), F.col("event_id")], 1, 20)


@query("distinct_users", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL ORDER BY user_id")
def distinct_users(spark, sf_dir):
    return executions(spark, sf_dir).select("user_id").filter("user_id is not null").distinct().orderBy("user_id")


@query("pass_rate_by_day", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS passed,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 4) AS pass_rate FROM {EXECUTIONS} GROUP BY 1""")
def pass_rate_by_day(spark, sf_dir):
    days = executions(spark, sf_dir).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), _with_status("success").alias("passed"))
    return days.withColumn("pass_rate", A.rate(F.col("passed"), F.col("total"), 4))


@query("status_pivot", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
  count(*) FILTER (WHERE event_type = 'refund') AS refund, count(*) FILTER (WHERE event_type IN ('click', 'error', 'purchase', 'refund')) AS total FROM events GROUP BY user_id""")
def status_pivot(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error", "purchase", "refund"])


@query("plan_run_counts", """
SELECT o_custkey AS plan_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active_runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed_runs FROM orders GROUP BY o_custkey""")
def plan_run_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plan_id")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("active_runs"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_runs"))


@query("relative_range_counts", """
WITH w AS (SELECT * FROM (VALUES ('7d', 7), ('30d', 30), ('90d', 90)) t(period, days)), m AS (SELECT max(ts) AS now FROM events)
SELECT period, count(*) AS n FROM w, m, events WHERE ts >= now - to_days(days) GROUP BY period""")
def relative_range_counts(spark, sf_dir):
    """Rows in the last 7, 30 and 90 days before the newest row, in one pass."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    ranges = {"7d": 7, "30d": 30, "90d": 90}
    within = F.array_compact(F.array(*[F.when(F.col("ts") >= F.lit(now) - F.make_interval(days=F.lit(d)), F.lit(p)) for p, d in ranges.items()]))
    return events.select(F.explode(within).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


@query("status_labels", """
SELECT status, status_label, count(*) AS n FROM (SELECT event_type AS status, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Passed' ELSE upper(event_type[1]) || event_type[2:] END AS status_label FROM events) GROUP BY ALL""")
def status_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), label("event_type", {"error": "Failed", "purchase": "Passed"}).alias("status_label"))
    return rows.groupBy("status", "status_label").agg(F.count("*").alias("n"))
