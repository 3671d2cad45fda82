"""Operator 12, importance resampling towards a target distribution by hashed n-grams.

Texts become a table of positions: words are posexploded, and ``lead()`` over a document's
positions sets the following words behind each word for every order. The n-grams are hashed into
buckets and grouped by document and bucket, which gives the counts of the whole corpus (an
aggregation to as many rows as there are buckets) and, with the gain of each bucket joined in,
the mean gain of each document. A bucket's gain is a thousand times the logarithm of its share in
the target over its share in the corpus, both with one added to every bucket. Documents are drawn
without replacement by the largest of weight plus Gumbel noise, hashed from seed and doc_id.

Whole texts are dealt out by row number before they are exploded, so windows and groups of a
document need no further shuffle, and neither a hot source nor a doc_id that repeats loads one
task. The counts are written once and read twice. Gains are a table of ``buckets`` rows, so they
are always broadcast. Ranks come from a sort by ranges: a row's rank is its place in its
partition behind the rows of all partitions before, whose number the driver sums, one row each.

Nulls: a null text has no words. A null doc_id is hashed as an empty text and drawn last among
equal scores. Repeated rows are scored and drawn each; equal scores and doc_ids are ordered by
weight, features, then any fixed way. Documents of fewer than ``min_words`` words get a score but
are never drawn. Texts may be empty (weight 0) or of any length. An empty corpus gives no rows,
an empty target counts as no features. Columns may have any names; doc_id any plain type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm._shared import column, lower_ascii, partitions, table, written

BUCKETS = 10_000
ORDERS = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: What stands between words: ASCII signs and control characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def counts(texts: DataFrame, id_col: str | None, text_col: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``(row, id, bucket, n, words)``: features of each document by bucket; words: those of order one.

    A row for every document at least: one with a null bucket where there are no words.
    """
    id_ = column(id_col) if id_col else F.lit(None).cast("long")
    rows = texts.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), column(text_col).alias("text")).repartition(partitions(texts), "row")
    words = F.array_remove(F.split(lower_ascii(F.col("text")), BETWEEN), "")
    placed = rows.select("row", "id", F.posexplode_outer(words).alias("at", "word"))
    document = Window.partitionBy("row").orderBy("at")
    following = placed.select("row", "id", "word", *[F.lead("word", k).over(document).alias(f"next{k}") for k in range(1, orders)])
    grams: list[Column] = [F.col("word")]
    for k in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"next{k}")))  # null where the text ends before
    each = following.select("row", "id", F.posexplode(F.array(*grams)).alias("order", "gram"))
    hashed = each.select("row", "id", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"), "order")
    word = F.when((F.col("order") == 0) & F.col("bucket").isNotNull(), 1)
    return hashed.groupBy("row", "id", "bucket").agg(F.count("bucket").alias("n"), F.count(word).alias("words"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket of the corpus; both: tables of ``(bucket, n)``."""
    source = written(corpus.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("s")), "resample-source")
    wanted = written(target.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("t")), "resample-target")
    all_s, all_t = (x.agg(F.sum(c)).first()[0] or 0 for x, c in ((source, "s"), (wanted, "t")))
    both = source.join(F.broadcast(wanted), "bucket", "left")
    share = (F.coalesce("t", F.lit(0)) + F.lit(1.0)) * F.lit(float(all_s + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def noise(seed: int, id_: Column) -> Column:
    """A thousand times Gumbel noise, floored, from the first eight hex digits of a SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weights(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(row, id, n_words, n_features, weight, score)`` of every document."""
    features = written(counts(documents, id_col, text_col, orders, buckets), "resample-features")
    gain = F.broadcast(gains(features, counts(target, None, target_col, orders, buckets), buckets))  # as many rows as buckets
    total, n = F.coalesce("total", F.lit(0).cast("long")), F.col("n_features")
    weight = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    summed = features.join(gain, "bucket", "left").groupBy("row").agg(
        F.first("id").alias("id"), F.sum("words").alias("n_words"), F.sum("n").alias("n_features"), F.sum(F.col("n") * F.col("gain")).alias("total")
    )
    weighed = summed.withColumn("total", total).select("row", "id", "n_words", "n_features", weight.alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(seed, F.col("id")))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``rank``, their place in the order over all partitions, from 1."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    placed = written(sorted_.select("*", F.monotonically_increasing_id().alias("place")), "resample-places")
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row per partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, part == F.col("part")).select(*rows.columns, (F.col("before") + inside + 1).alias("rank"))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; rank: of the drawn ones by score, null for the others."""
    scored = written(weights(documents, target, id_col, **options), "resample-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = F.lit(percent * able.count() // 100)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("row")]
    placed = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _grams(rows: str, key: str) -> str:
    """SQL for the features of all texts of a table, a row each with its key."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT {key} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram
  FROM (SELECT {key}, list_filter(string_split_regex({lower}, '{BETWEEN}'), lambda x: x <> '') AS w FROM {rows})"""


#: The CRC of a text: a fold of its bytes through the table of the reversed polynomial EDB88320.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(gram)), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])))"""

SQL = f"""
WITH RECURSIVE crc_bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(0, 256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE k = 8),
ours AS ({_grams("documents", "doc_id")}),
theirs AS ({_grams("benchmark", "item_id")}),
hashed AS (SELECT gram, {_CRC} % {BUCKETS} AS bucket FROM (SELECT gram FROM ours UNION SELECT gram FROM theirs), crc_table),
s AS (SELECT bucket, count(*) AS s FROM ours JOIN hashed USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM theirs JOIN hashed USING (gram) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
summed AS (SELECT id, count(*) AS n, count(*) FILTER (gram NOT LIKE '% %') AS words, sum(gain) AS total FROM ours JOIN hashed USING (gram) JOIN gain USING (bucket) GROUP BY id),
weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(words, 0) AS words, coalesce(floor(total / n), 0)::BIGINT AS weight FROM documents LEFT JOIN summed ON id = doc_id),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM placed) // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
