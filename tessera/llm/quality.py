"""Operator 2, quality rules with risk-controlled thresholds.

Each rule rejects texts whose ratio exceeds a cutoff. Cutoffs come from labelled holdout rows:
in a stratum with n good texts (quality 1, base not failed) of which a rule at a cutoff rejects k,
an exact binomial test asks whether the true rate of false rejections is below ``alpha`` divided by
the number of rules: its p-value is P(Bin(n, alpha / rules) <= k). The cutoffs of a rule are nested,
so they are tested in a fixed sequence from lax to strict, each at the level ``delta`` over the
number of strata and rules (Bonferroni), up to the first that fails; the last that passed counts.
With none, the rule does not apply in that stratum. With probability 1 - delta, no stratum then
loses more than a share alpha of its good texts to all rules together. The bound needs independent
draws, so a text that is labelled several times counts once.

Features of every whole text are columns of one projection (no explode, no shuffle of texts) and
are written once, without texts. Counts per stratum are one aggregation of labelled rows. All is
DataFrame code.

Nulls: a null text has no words, so the base fails. A null stratum is one of its own. A null
doc_id matches no label. Null labels are left out; a doc_id with several labels is good if all
are 1, and a text is counted as good if one of its rows is. Repeated rows get the same result each.
Texts of any length are read whole. Other columns are not read, whatever their names. An empty table
gives no rows, and without labels only the base decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, let, table, written

ALPHA, DELTA = 0.05, 0.05
#: Rules: a ratio of two features, and its cutoffs from strict to lax.
CUTOFFS = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "bangs": ("n_bangs", "n_words"),
}
#: Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included."""

    def of_sorted(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))

        at = F.transform(F.filter(s, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(at)))

    def of_hashes(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(placed), of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, of_hashes)).cast("long")


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every whole text, and ``base_failed``."""
    text = F.coalesce(column(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    worded = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    counted = documents.select(
        column(id_col).cast("long").alias("doc_id"),
        column(stratum_col).cast("string").alias("stratum"),
        F.xxhash64(text).alias("text_hash"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count(text, _SYMBOLS).alias("n_symbols"),
        _count(text, _CAPITALS).alias("n_capitals"),
        _count(text, "!").alias("n_bangs"),
        lined.alias("l"),
        worded.alias("w"),
    ).select("doc_id", "stratum", "text_hash", "word_chars", "n_symbols", "n_capitals", "n_bangs", "l.*", "w.*")
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratio(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _log_factorial(x: Column) -> Column:
    """By Stirling's series at x + 9, stepped down; to about thirteen digits."""
    y = x + 9
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    steps = F.log(x + 1)
    for i in range(2, 9):
        steps = steps + F.log(x + i)
    return series - steps


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) where k < n * p, else 1: the sum from k downwards to where terms vanish."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, F.ceil(60 + 12 * F.sqrt(n * p))).cast("int")

    def add(now: Column, j: Column) -> Column:
        return F.struct((now["sum"] + now["term"]).alias("sum"), (now["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"))

    total = F.aggregate(F.sequence(F.lit(0), terms), F.struct(F.lit(0.0).alias("sum"), first.alias("term")), add, lambda x: x["sum"])
    return F.when(k < n * p, total).otherwise(1.0)


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, label_col: str = "quality") -> DataFrame:
    """``(stratum, <rule>, ...)``: the admitted cutoff of each rule, null where there is none."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("good"))
    good = rows.filter(~F.col("base_failed")).join(marks.filter("good = 1"), "doc_id", "left_semi").dropDuplicates(["stratum", "text_hash"])
    rejected = [F.count_if(_ratio(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)]
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    level = delta / (max(1, counts.count()) * len(RULES))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(CUTOFFS)]))
    tried = counts.select("stratum", "n", each.alias("t")).select("stratum", "n", "t.*")
    failed = F.when(binomial_cdf(F.col("n"), F.col("k"), alpha / len(RULES)) > level, F.col("cutoff"))
    tested = tried.withColumn("failed", failed).groupBy("stratum", "rule").agg(F.max("failed").alias("first"), F.collect_list("cutoff").alias("all"))  # first: of the sequence from lax to strict
    passed = tested.withColumn("cutoff", F.array_min(F.filter("all", lambda c: F.col("first").isNull() | (c > F.col("first")))))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES])


def judge(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts of every row with ``base_failed`` and ``kept``."""
    rows = written(features(documents, id_col, text_col, stratum_col), "quality")
    limits = written(cutoffs(rows, labels.select(column(id_col).cast("long").alias("doc_id"), "quality"), alpha, delta), "quality-cutoffs")
    limits = limits.withColumnRenamed("stratum", "_stratum")
    if limits.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = rows.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.col("base_failed")
    for rule in RULES:
        failed = failed | F.coalesce(_ratio(rule) > F.col(rule), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    ratio = {r: f"{a}::DOUBLE / greatest({b}, 1)" for r, (a, b) in RULES.items()}
    counts = ", ".join(f"count(*) FILTER (WHERE {ratio[r]} > {c}) AS {r}_{i}" for r in RULES for i, c in enumerate(CUTOFFS))
    p = ALPHA / len(RULES)
    cdf = "list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(%r) + (n - i) * ln(%r))))" % (p, 1 - p)
    level = f"({DELTA} / ((SELECT count(*) FROM counts) * {len(RULES)}))"
    lax = list(enumerate(CUTOFFS))[::-1]
    passes = lambda r, i: f"({r}_{i} < n * {p!r} AND {cdf.format(k=f'{r}_{i}')} <= {level})"
    least = ", ".join(f"CASE {' '.join(f'WHEN NOT {passes(r, i)} THEN {lax[at - 1][1] if at else "NULL"}' for at, (i, _) in enumerate(lax))} ELSE {CUTOFFS[0]} END AS {r}" for r in RULES)
    failed = " OR ".join(f"coalesce({ratio[r]} > limits.{r}, false)" for r in RULES)
    symbols = "length(text) - length(translate(text, '{}', ''))"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
),
windows AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often, range(0, 3) t(k) WHERE c > 1 GROUP BY r),
f AS (
  SELECT r, doc_id, text, lang AS stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({symbols.format(_SYMBOLS)})::BIGINT AS n_symbols,
    ({symbols.format(_CAPITALS)})::BIGINT AS n_capitals, ({symbols.format("!")})::BIGINT AS n_bangs,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated USING (r)
),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
good AS (SELECT DISTINCT ON (stratum, text) * FROM base WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
counts AS (SELECT stratum, count(*) AS n, {counts} FROM good GROUP BY stratum),
limits AS (SELECT stratum, {least} FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {failed}) AS kept
FROM base LEFT JOIN limits ON base.stratum IS NOT DISTINCT FROM limits.stratum
"""


SQL = _sql()
