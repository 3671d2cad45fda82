"""Failure diagnosis: collect, de-duplicate, redact, classify by rules, fall back, count.

Logs: (log_id, endpoint, method, status_code, error_message, request, response, created_at).
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Rules as (id, category, priority, confidence, status codes or none for any, patterns).
RULES = (
    ("token_expired_rule_1", "token_expired", 100, 0.95, (401,), ("token.*expir", "invalid_token", "unauthorized", "jwt.*invalid", "access_token.*invalid")),
    ("permission_denied_rule_1", "permission_denied", 95, 0.90, (403,), ("forbidden", "insufficient", "permission.*denied", "not.*allowed", "role.*required")),
    ("api_changed_rule_1", "api_changed", 90, 0.90, (404,), ("not found", "no route", "no endpoint")),
    ("api_changed_rule_2", "api_changed", 80, 0.85, (400, 422), ("column.*not found", "field.*unknown", "unknown column")),
    ("data_error_rule_1", "data_error", 70, 0.85, (400,), ("validation", "constraint", "not null", "invalid.*format")),
    ("network_timeout_rule_1", "network_timeout", 60, 0.90, (504, 502, 503), ("timeout", "ETIMEDOUT", "ECONNREFUSED", "connection refused")),
    ("script_error_rule_1", "script_error", 50, 0.95, (), ("TypeError", "ReferenceError", "SyntaxError", "cannot read property", "is not a function")),
)
#: The fallback's words by category, in order.
FALLBACK = (
    ("token_expired", ("token", "unauthorized", "jwt")),
    ("permission_denied", ("forbidden", "permission")),
    ("api_changed", ("not found", "no route")),
    ("network_timeout", ("timeout", "refused")),
    ("script_error", ("typeerror", "referenceerror")),
)
CATEGORIES = ("token_expired", "permission_denied", "api_changed", "data_error", "network_timeout", "script_error", "unknown")
#: Header names and body fields whose values are hidden; compared without case.
SECRET_HEADERS = ("authorization", "cookie", "x-api-key", "x-apikey", "token", "x-auth-token")
SECRET_FIELDS = ("password", "secret", "token", "accessToken", "refreshToken", "creditCard", "phone", "idCard", "id_card", "ssn", "api_key", "apikey")
#: Both, and other spellings that this library hides as well.
SECRET_KEYS = tuple(sorted({k.lower() for k in (*SECRET_HEADERS, *SECRET_FIELDS, "set-cookie", "access_token", "refresh_token")}))


def dedup(logs: DataFrame, keys: Sequence[str] = ("endpoint", "method", "status_code"), order: Sequence[str] = ("created_at", "log_id")) -> DataFrame:
    """The first log of each key in order of arrival."""
    rest = [c for c in logs.columns if c not in keys and c not in order]
    first = logs.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in logs.columns])


def rule_hit(status: Column, message: Column, rules: Sequence[tuple] = RULES) -> Column:
    """The struct (rule, category, confidence) of the first rule by priority that matches, or null.

    Rules are few and fixed, so they become one CASE: no join, and the first hit ends the search.
    """
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("category"), F.lit(0.0).alias("confidence")))
    for rule, category, _, confidence, codes, patterns in sorted(rules, key=lambda r: -r[2]):
        fits = F.coalesce(message, F.lit("")).rlike(f"(?i){'|'.join(patterns)}")
        fits = fits & status.isin(list(codes)) if codes else fits
        out = out.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence")))
    return out


def fallback(message: Column) -> Column:
    """The struct (category, confidence) by words in the message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for category, words in FALLBACK:
        fits = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        hit = F.struct(F.lit(category).alias("category"), F.lit(0.7).alias("confidence"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out.otherwise(F.struct(F.lit("unknown").alias("category"), F.lit(0.5).alias("confidence")))


def classify(logs: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """Logs with root_cause, classifier (rule or fallback), matching_rule and confidence."""
    marked = logs.withColumn("_r", rule_hit(F.col("status_code"), F.col("error_message"), rules)).withColumn("_f", fallback(F.col("error_message")))
    ruled = F.col("_r").isNotNull()
    return marked.withColumns({
        "root_cause": F.when(ruled, F.col("_r.category")).otherwise(F.col("_f.category")),
        "classifier": F.when(ruled, "rule").otherwise("fallback"),
        "matching_rule": F.col("_r.rule"),
        "confidence": F.when(ruled, F.col("_r.confidence")).otherwise(F.col("_f.confidence")),
    }).drop("_r", "_f")


def rules_first(findings: DataFrame) -> list[Column]:
    """The order of a report: findings by rules before fallbacks, the surest first, then by log."""
    return [F.when(F.col("classifier") == "rule", 0).otherwise(1), F.desc("confidence"), F.col("log_id")]


def rule_stats(findings: DataFrame) -> DataFrame:
    """``(matching_rule, hits, hit_rate)`` over all findings; the null rule counts fallbacks."""
    counts = findings.groupBy("matching_rule").agg(F.count("*").alias("hits"))
    total = findings.count()
    return counts.withColumn("hit_rate", F.round(F.col("hits") / max(total, 1), 4))


def redact_json(json_: Column, keys: Sequence[str] = SECRET_KEYS) -> Column:
    """The whole values of secret keys hidden at any depth, be they scalars, objects or lists; the rest stays as it is written.

    Scalars are replaced by a pattern. Only texts with an object or list under a secret key go to Python, which finds where it
    ends; in broken JSON all that follows such a key is hidden.
    """
    names = "|".join(re.escape(k) for k in keys)
    key = rf'(?i)("(?:{names})"\s*:\s*)'
    scalars = F.regexp_replace(json_, key + r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|true|false|null)', '$1"***"')
    opens = re.compile(rf'"(?:{names})"\s*:\s*(?=[\[{{])', re.IGNORECASE)

    def hidden(text: str) -> str:
        out, at = [], 0
        while found := opens.search(text, at):
            out += [text[at : found.end()], '"***"']
            try:
                at = json.JSONDecoder().raw_decode(text, found.end())[1]
            except ValueError:
                at = len(text)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def containers(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hidden(t))

    nested = F.rlike(json_, F.lit(key + r"[\[{]"))
    return F.when(nested, containers(F.when(nested, scalars))).otherwise(scalars)


def level(logs_found: Column, code_found: Column) -> Column:
    return F.when(logs_found & code_found, "none").when(logs_found, "partial").otherwise("severe")


def cache_key(status: Column, method: Column, endpoint: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("|", status.cast("string"), method, endpoint, message), 256)


def retained(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days before now."""
    return df.filter(F.col(column) >= now - F.make_interval(days=F.lit(days)))


def search_terms(endpoint: Column, message: Column) -> Column:
    """Words to look for in code: parts of the path but api and versions, and up to three identifiers of the message."""
    parts = F.filter(F.split(endpoint, "/"), lambda p: ~p.isin("", "api", "v1", "v2"))
    names = F.slice(F.regexp_extract_all(message, F.lit("([A-Za-z_][A-Za-z0-9_]{3,})"), 1), 1, 3)
    return F.array_distinct(F.concat(parts, names))


#: The methods, and the words of which one must stand behind the status.
HTTP_METHODS, FAILED_WORDS = ("GET", "POST", "PUT", "DELETE", "PATCH"), ("error", "fail", "timeout")
#: Characters of the text from the method on that are kept as message.
MESSAGE = 200


def http_errors(text: Column) -> Column:
    """All ``METHOD /path ... [nnn] ... error`` within lines of a text, in any case, as structs (method, path, status, message).

    The message is what stands from the method on, also beyond the line, up to MESSAGE characters; a look-ahead takes it,
    only where a method stands.
    """
    ahead = rf"(?=(?:{'|'.join(HTTP_METHODS)})\s)(?=((?s:.{{0,{MESSAGE}}})))"
    start = rf"({'|'.join(HTTP_METHODS)})\s+(/\S+)\s+.*?\[([0-9]{{3}})\]"
    pattern = rf"(?i){ahead}{start}.*?(?:{'|'.join(FAILED_WORDS)})"
    whole = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), i).alias(n) for i, n in enumerate(("all", "message"))])
    part = lambda s, i: F.regexp_extract(s["all"], rf"(?i)^{start}", i)
    return F.transform(whole, lambda s: F.struct(F.upper(part(s, 1)).alias("method"), part(s, 2).alias("path"), part(s, 3).cast("int").alias("status"), s["message"].alias("message")))
