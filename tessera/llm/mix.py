"""Operator 1, mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output rows over its rows. A
document's count is the inverse of the Poisson distribution with that mean at a uniform number
hashed from a seed and its doc_id, so the same document gets the same count in every run and on
every cluster. Documents are exploded by their counts and shuffled globally: copies are sorted
by a second hash of doc_id and copy, ``mix_key``, over all partitions.

A source with a third of all rows needs no special care: counts are summed before the shuffle,
rows get their rate by a join with a table of one row per source, and the global shuffle deals
copies by ranges of mix_key, not by source. Rows of one mix_key (a doc_id that repeats, null
doc_ids) are ordered by a hash of their columns of plain types, and those alike in that by the
partition they came from, so ranges split them as well.

Nulls: rows with a null source are a source of their own. A null doc_id is hashed as an empty
text. Repeated rows get equal counts each. Texts are never looked at, so they may be empty or of
any length. Without weights a source's target share is in proportion to its rows to the power
``temperature``. Sources without a weight, and those of weight zero, do not appear in the output.
An empty table gives no rows. Columns of documents stay as they are, whatever their names and
types; the added ones are ``copy`` and ``mix_key``, which replace equally named ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, partitions, row_hash, table, whole_row

TEMPERATURE = 0.5
SEED = 42
#: Sources up to which the table of rates is broadcast.
BROADCAST_SOURCES = 100_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ..., to where it is 1 in doubles."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def add(now: Column, k: Column) -> Column:
        log = now["log"] + F.log(rate) - F.log(k.cast("double"))
        total = now["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(now["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), first, add, lambda x: x["steps"])


def rates(documents: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """``(source, rate)``, one row per source; total: the rows wanted, as many as there are by default."""
    counts = documents.groupBy(column(source_col).alias("source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        share = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = documents.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, w double")
        share = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("given")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    all_w, all_n = share.agg(F.sum("w"), F.sum("n")).first()
    wanted = (all_n or 0.0) if total is None else float(total)
    return share.select("source", (F.lit(wanted) * F.col("w") / F.lit(all_w or 1.0) / F.col("n")).alias("rate"))


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, id_col: str = "doc_id", source_col: str = "source", temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Documents exploded by their counts, in a global random order: partitions, and rows in them by mix_key."""
    kept = documents.drop("copy", "mix_key")
    rate = rates(documents, weights, total, source_col, temperature).filter("rate > 0").select(F.col("source").alias("of"), poisson_steps(F.col("rate")).alias("steps"))
    if rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    rows = documents.select(whole_row(kept).alias("row"), column(source_col).alias("source"), column(id_col).alias("id"), row_hash(kept).alias("tie"), uniform(seed, column(id_col)).alias("u"))
    counted = rows.join(rate, F.col("source").eqNullSafe(F.col("of"))).withColumn("n", F.size(F.filter("steps", lambda s: F.col("u") >= s)))
    copies = counted.filter("n > 0").select("row", "id", "tie", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    # the partition of the input, which a repeated task has again, parts rows that are alike in all
    keyed = copies.select("row", "copy", uniform(seed + 1, F.col("id"), F.col("copy")).alias("mix_key"), "tie", F.spark_partition_id().alias("salt"))
    order = ["mix_key", "tie", "salt"]
    return keyed.repartitionByRange(partitions(documents), *order).sortWithinPartitions(*order).select("row.*", "copy", "mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


SQL = f"""
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) * pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM counts) / n AS rate FROM counts),
terms AS (
  SELECT r.source, k, sum(exp(-r.rate + k * ln(r.rate) - lgamma(k + 1))) OVER (PARTITION BY r.source ORDER BY k) AS step
  FROM rates r, generate_series(0, 200) t(k)
),
drawn AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars, count(*) AS n
  FROM drawn d JOIN terms t ON t.source IS NOT DISTINCT FROM d.source AND d.u >= t.step GROUP BY d.doc_id
),
copies AS (SELECT * EXCLUDE (n), unnest(generate_series(1, n))::INTEGER AS copy FROM counted)
SELECT *, ('0x' || substr(md5('{SEED + 1}:' || doc_id || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS mix_key FROM copies
"""
