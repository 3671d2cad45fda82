import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import resample as r
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


def features(text, orders=2):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(documents, target, percent=25, min_words=20, orders=2, buckets=10_000, seed=7):
    """The contract, a document at a time."""

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, text in documents for f in features(text, orders)[1])
    t = Counter(bucket(f) for text in target for f in features(text, orders)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, text in documents:
        words, found = features(text, orders)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in rows if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    for place, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = place
    return sorted(str(tuple(x[:5])) for x in rows)


def got(frame):
    return sorted(str((x.doc_id, x.n_features, x.weight, x.score, x.rank)) for x in frame.collect())


def test_query_equals_brute_force_and_sql(spark):
    documents = [(x.doc_id, x.text) for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [x.text for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    frame = r.query(spark, FOLDER).cache()
    assert got(frame) == brute(documents, target)
    assert oracle.rows(frame.toPandas()) == oracle.rows(oracle.database(FOLDER).execute(r.SQL).df())


TEXTS = ["One two, three-four " * 8, "", None, "  ,,, ", "word", "ÄÖ äö É é naïve 東京 １２ x_y" * 10, "a b " * 40_000, "\x7f\x00A\x01b", "[brackets] 99 bottles `of` beer " * 7]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_edge_rows(spark, orders):
    documents = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, TEXTS[0]), (3, TEXTS[0]), (3, TEXTS[0]), (None, None)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("bucket", F.lit(1.5)).withColumn("score", F.lit(None).cast("int")).repartition(3)
    target = spark.createDataFrame([("three four beer",), (None,), ("",)], "text string").withColumn("n", F.lit(1))
    want = brute(documents, ["three four beer", None, ""], percent=60, orders=orders)
    assert got(r.resample(frame, target, percent=60, orders=orders)) == want
    assert got(r.resample(frame, target.limit(0), percent=60, orders=orders)) == brute(documents, [], percent=60, orders=orders)
    assert r.resample(frame.limit(0), target).count() == 0


def test_ids_that_are_texts(spark):
    frame = spark.createDataFrame([("b", TEXTS[0]), ("a", TEXTS[0]), (None, "")], "key string, body string")
    target = spark.createDataFrame([("one",)], "question string")
    rows = r.resample(frame, target, percent=100, id_col="key", text_col="body", target_col="question").collect()
    assert {x.doc_id for x in rows} == {"a", "b", None} and sorted(x.rank for x in rows if x.rank) == [1, 2]


def test_ranks_go_over_partitions(spark):
    rows = spark.range(10_000).selectExpr("id % 37 as a", "id").repartition(7)
    placed = r.ranked(rows, [F.col("a").desc(), F.col("id")]).collect()
    assert [x.rank for x in sorted(placed, key=lambda x: (-x.a, x.id))] == list(range(1, 10_001))


def test_no_python_on_the_main_path(spark):
    plan = r.query(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_of_a_document_are_not_shuffled(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = r.counts(documents, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Window")
