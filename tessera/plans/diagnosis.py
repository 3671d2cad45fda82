"""Diagnosis over events: a failure log per event, its message and status by type and number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes as C, diagnosis as D
from tessera.operators.aggregates import histogram
from tessera.plans.registry import query
from tessera.sources.tables import table

MESSAGES = (
    (401, "Token expired"), (403, "insufficient permissions"), (404, "no route matched"), (422, "field unknown"), (400, "validation failed"), (504, "Gateway Timeout"),
    (200, "TypeError: foo is not a function"), (418, "I am a teapot"), (500, "jwt lost"), (500, "peer refused"),
)
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LOGS = f"""logs AS (SELECT event_id AS log_id, '/api/v2/' || event_type || '/' || user_id % 7 AS endpoint, CASE {_K} % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
  CASE {_K} % 10 {" ".join(f"WHEN {i} THEN {c}" for i, (c, _) in enumerate(MESSAGES))} END AS status_code, CASE {_K} % 10 {" ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(MESSAGES))} END AS error_message, ts AS created_at FROM events)"""


def _rlike(patterns) -> str:
    return f"regexp_matches(error_message, '(?i){'|'.join(patterns)}')"


_CASES = [(r, c, p, f"{_rlike(pats)}" + (f" AND status_code IN ({', '.join(map(str, codes))})" if codes else "")) for r, c, _, p, codes, pats in sorted(D.RULES, key=lambda r: -r[2])]
_FALLS = [(c, " OR ".join(f"contains(lower(error_message), '{w}')" for w in words)) for c, words in D.FALLBACK]
_CLASSIFIED = f"""{_LOGS}, ruled AS (SELECT *, CASE {" ".join(f"WHEN {w} THEN '{r}'" for r, _, _, w in _CASES)} END AS matching_rule FROM logs),
found AS (SELECT *, CASE {" ".join(f"WHEN matching_rule = '{r}' THEN '{c}'" for r, c, _, _ in _CASES)} {" ".join(f"WHEN {w} THEN '{c}'" for c, w in _FALLS)} ELSE 'unknown' END AS root_cause,
  CASE WHEN matching_rule IS NULL THEN 'fallback' ELSE 'rule' END AS classifier, CASE {" ".join(f"WHEN matching_rule = '{r}' THEN {p}" for r, _, p, _ in _CASES)} {" ".join(f"WHEN {w} THEN 0.7" for _, w in _FALLS)} ELSE 0.5 END::DOUBLE AS confidence FROM ruled)"""


def logs(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("/api/v2/"), "event_type", F.lit("/"), (F.col("user_id") % 7).cast("string")).alias("endpoint"),
        F.when(k % 3 == 0, "GET").when(k % 3 == 1, "POST").otherwise("PUT").alias("method"),
        at([c for c, _ in MESSAGES]).alias("status_code"),
        at([m for _, m in MESSAGES]).alias("error_message"),
        F.col("ts").alias("created_at"),
    )


@query("rule_classify", f"WITH {_CLASSIFIED} SELECT log_id, root_cause, classifier, matching_rule, confidence FROM found")
def rule_classify(spark, sf_dir):
    return D.classify(logs(spark, sf_dir)).select("log_id", "root_cause", "classifier", "matching_rule", "confidence")


@query("keyword_fallback", f"WITH {_LOGS} SELECT log_id, CASE {' '.join(f'WHEN {w} THEN ' + repr(c) for c, w in _FALLS)} ELSE 'unknown' END AS category FROM logs")
def keyword_fallback(spark, sf_dir):
    return logs(spark, sf_dir).select("log_id", D.fallback(F.col("error_message"))["category"].alias("category"))


@query("root_cause_histogram", f"WITH {_CLASSIFIED} SELECT {', '.join(f'count(*) FILTER (WHERE root_cause = ' + repr(c) + f') AS {c}' for c in D.CATEGORIES)} FROM found")
def root_cause_histogram(spark, sf_dir):
    return histogram(D.classify(logs(spark, sf_dir)), "root_cause", D.CATEGORIES, "unknown")


@query("rule_hit_stats", f"WITH {_CLASSIFIED} SELECT matching_rule, count(*) AS hits, round(count(*) / (SELECT count(*) FROM found), 4) AS hit_rate FROM found GROUP BY 1")
def rule_hit_stats(spark, sf_dir):
    return D.rule_stats(D.classify(logs(spark, sf_dir)))


@query("dedup_failures", f"WITH {_LOGS} SELECT endpoint, method, status_code, arg_min(log_id, {{'t': created_at, 'i': log_id}}) AS log_id FROM logs GROUP BY 1, 2, 3")
def dedup_failures(spark, sf_dir):
    return D.dedup(logs(spark, sf_dir)).select("endpoint", "method", "status_code", "log_id")


@query("diagnosis_report", f"""
WITH {_CLASSIFIED}, firsts AS (SELECT arg_min(log_id, {{'t': created_at, 'i': log_id}}) AS log_id FROM logs GROUP BY endpoint, method, status_code)
SELECT log_id, endpoint, method, status_code, root_cause, classifier FROM found WHERE log_id IN (SELECT log_id FROM firsts) ORDER BY (classifier <> 'rule'), log_id""")
def diagnosis_report(spark, sf_dir):
    """De-duplicated, then classified; rule hits come first."""
    return D.classify(D.dedup(logs(spark, sf_dir))).select("log_id", "endpoint", "method", "status_code", "root_cause", "classifier").orderBy(F.when(F.col("classifier") == "rule", 0).otherwise(1), "log_id")


@query("diagnosis_cache_keys", f"WITH {_LOGS} SELECT DISTINCT sha256(concat_ws('|', status_code::VARCHAR, method, endpoint, error_message)) AS cache_key FROM logs")
def diagnosis_cache_keys(spark, sf_dir):
    return logs(spark, sf_dir).select(D.cache_key(F.col("status_code"), F.col("method"), F.col("endpoint"), F.col("error_message")).alias("cache_key")).distinct()


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return D.retained(events, "ts", F.lit(events.agg(F.max("ts")).first()[0]), 10).select("event_id")


@query("already_diagnosed", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-04')")
def already_diagnosed(spark, sf_dir):
    """Runs that have no report under their key yet."""
    events = table(spark, sf_dir, "events")
    done = events.filter("event_type = 'signup' and ts < timestamp_ntz '2024-01-04'").select("user_id")
    return events.filter("event_type = 'error'").select("user_id").distinct().join(done, "user_id", "left_anti")


@query("upsert_of_two_stores", """
WITH old AS (SELECT user_id, min(event_id) AS report, 'old' AS state FROM events WHERE event_type = 'signup' GROUP BY 1), new AS (SELECT user_id, max(event_id) AS report, 'new' AS state FROM events WHERE event_type = 'error' AND user_id % 3 <> 0 GROUP BY 1)
SELECT 'relational' AS store, * FROM old UNION ALL SELECT 'relational', * FROM new WHERE user_id NOT IN (SELECT user_id FROM old) UNION ALL SELECT 'document', * FROM new UNION ALL SELECT 'document', * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def upsert_of_two_stores(spark, sf_dir):
    """Reports by run: the relational store keeps what it has under a key, the document store replaces it."""
    events = table(spark, sf_dir, "events")
    old = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("report")).withColumn("state", F.lit("old"))
    new = events.filter("event_type = 'error' and user_id % 3 <> 0").groupBy("user_id").agg(F.max("event_id").alias("report")).withColumn("state", F.lit("new"))
    kept, replaced = C.get_or_create(old, new, ["user_id"]), C.replace_versions(old, new, ["user_id"])
    return kept.select(F.lit("relational").alias("store"), "*").union(replaced.select(F.lit("document"), "*"))


@query("degradation_level", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_nationkey > 5 THEN 'none' WHEN s_acctbal > 0 THEN 'partial' ELSE 'severe' END AS level FROM supplier")
def degradation_level(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.level(F.col("s_acctbal") > 0, F.col("s_nationkey") > 5).alias("level"))


@query("redact", """
SELECT event_id, '{"Authorization": "***", "data": {"accessToken": "***", "name": "' || event_type || '", "phone": "***", "list": [{"ssn": "***"}, {"note": "token"}]}, ' ||
  CASE event_id % 3 WHEN 0 THEN '"password": "***", ' WHEN 1 THEN '"creditCard": "***", "x-auth-token": "***", ' ELSE '"idCard" : "***", ' END || '"k": ' || json_extract_string(props, '$.k') || '}' AS request FROM events""")
def redact(spark, sf_dir):
    """Secrets as scalars, objects and lists, at the top, in objects and in lists."""
    more = F.when(F.col("event_id") % 3 == 0, '"password": ["p1", {"secret": "p2}"}], ').when(F.col("event_id") % 3 == 1, '"creditCard": {"number": {"value": "4111]"}}, "x-auth-token": true, ').otherwise('"idCard" : [], ')
    start = F.format_string('{"Authorization": "Bearer %s", "data": {"accessToken": "a\\"b%d", "name": "%s", "phone": %d, "list": [{"ssn": {"a": 1}}, {"note": "token"}]}, ', "event_type", "event_id", "event_type", "user_id")
    request = F.concat(start, more, F.lit('"k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", D.redact_json(request).alias("request"))


@query("code_search_terms", f"""WITH {_LOGS}, t AS (SELECT log_id, list_filter(string_split(endpoint, '/'), lambda p: p NOT IN ('', 'api', 'v1', 'v2')) AS a, regexp_extract_all(error_message, '([A-Za-z_][A-Za-z0-9_]{{3,}})', 1)[1:3] AS b FROM logs)
SELECT log_id, len(list_distinct(list_concat(a, b))) AS n_terms, array_to_string(a, '/') || '|' || array_to_string(b, '/') AS terms FROM t""")
def code_search_terms(spark, sf_dir):
    rows = logs(spark, sf_dir).select("log_id", D.search_terms(F.col("endpoint"), F.col("error_message")).alias("t"), "endpoint", "error_message")
    names = F.slice(F.regexp_extract_all("error_message", F.lit("([A-Za-z_][A-Za-z0-9_]{3,})"), 1), 1, 3)
    parts = F.filter(F.split("endpoint", "/"), lambda p: ~p.isin("", "api", "v1", "v2"))
    return rows.select("log_id", F.size("t").alias("n_terms"), F.concat(F.array_join(parts, "/"), F.lit("|"), F.array_join(names, "/")).alias("terms"))


_OUTPUT = """paths AS (SELECT *, replace(endpoint, '/error/', '/fault/') AS path FROM logs), lines AS (SELECT log_id, CASE log_id % 2 WHEN 0 THEN method ELSE lower(method) END || ' ' || path || ' gave [' || status_code || '] ' ||
  CASE log_id % 4 WHEN 0 THEN 'Error: ' || error_message WHEN 1 THEN 'and TIMEOUT' WHEN 2 THEN 'as it should' ELSE 'failed twice' END AS line FROM paths),
texts AS (SELECT log_id, 'run ' || log_id || chr(10) || line || chr(10) || repeat(line || ' ', 3) AS text, line FROM lines)"""


@query("http_errors", f"""WITH {_LOGS}, {_OUTPUT}
SELECT log_id, method, path, status_code AS status, substr(text, instr(text, line), 200) AS message, 1 AS line FROM texts JOIN paths USING (log_id) WHERE log_id % 4 <> 2
UNION ALL SELECT log_id, method, path, status_code, substr(text, length(text) - 3 * length(line) - 2 + i * (length(line) + 1), 200), 2 FROM texts JOIN paths USING (log_id), (VALUES (0), (1), (2)) t(i) WHERE log_id % 4 <> 2""")
def http_errors(spark, sf_dir):
    """Method, path, status and message scraped from output; of each log one line with one error, and one with three."""
    said = F.when(F.col("log_id") % 4 == 0, F.concat(F.lit("Error: "), "error_message")).when(F.col("log_id") % 4 == 1, "and TIMEOUT").when(F.col("log_id") % 4 == 2, "as it should").otherwise("failed twice")
    method = F.when(F.col("log_id") % 2 == 0, F.col("method")).otherwise(F.lower("method"))
    line = F.concat_ws(" ", method, F.replace("endpoint", F.lit("/error/"), F.lit("/fault/")), F.lit("gave"), F.format_string("[%d]", "status_code"), said)
    text = F.concat(F.format_string("run %d\n", "log_id"), line, F.lit("\n"), F.repeat(F.concat(line, F.lit(" ")), 3))
    found = logs(spark, sf_dir).select("log_id", F.posexplode(D.http_errors(text)).alias("n", "e"))
    return found.select("log_id", "e.*", F.when(F.col("n") == 0, 1).otherwise(2).alias("line"))
