import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I, search

WORDS = ["the", "cat", "dog", "bird", "fish", "tree", "stone", "rare"]


def documents(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choices(WORDS, weights=[30, 9, 8, 5, 4, 3, 2, 0.2], k=rng.randrange(30)))) for i in range(n)]
    return [*rows, (n, "a", None), (n + 1, "*", "the the the"), (n + 2, "b", "Cat\tDOG  cat")]


def brute(rows, query, k, kind=None):
    texts = {i: (t or "").lower().split() for i, own, t in rows if kind is None or (own or "") == kind}
    n, length = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {}
    for words in texts.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    scores = {}
    for i, words in texts.items():
        parts = [(search.FLOOR * mean if raw[t] < 0 else raw[t]) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / length)) for t in dict.fromkeys(query.lower().split()) if t in raw]
        scores[i] = round(100 * sum(parts), 6) + 0.0
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def rows_of(frame):
    return [(r.id, pytest.approx(r.score, abs=2e-6)) for r in sorted(frame.collect(), key=lambda r: (-r.score, r.id))]


@pytest.fixture
def path(spark, tmp_path):
    return f"file://{tmp_path}/index"


SCHEMA = "id long, kind string, text string"


@pytest.mark.parametrize("unpruned", [0, 10_000])
def test_scores_equal_brute_force(spark, path, unpruned):
    rows = documents(600, 1)
    index = I.build(spark.createDataFrame(rows, SCHEMA).repartition(3), path, "id", "text", "kind", shards=5, width=16)
    for query, k in (("rare stone", 7), ("dog fish rare", 20), ("the", 9), ("THE cat rare", 5), ("unknown", 4), ("", 3), ("rare", 200)):
        assert brute(rows, query, k) == rows_of(I.bm25(index, query, k, unpruned=unpruned)), query
        for kind in ("a", "", "*"):
            assert brute(rows, query, k, kind) == rows_of(I.bm25(index, query, k, kind, unpruned=unpruned)), (query, kind)
    assert I.bm25(index, "cat", 5, "no such type").count() == 0


def test_full_text_equals_a_scan(spark, path):
    frame = spark.createDataFrame(documents(300, 2), SCHEMA)
    index = I.build(frame, path, "id", "text", "kind", width=16)
    for query in ("cat dog", "the cat", "the", "", "rare bird cat", "nothing"):
        assert sorted(I.full_text(index, query).collect()) == sorted(search.full_text(frame, "id", "text", query).collect())
    assert {r.id for r in I.full_text(index, "cat dog", "b").collect()} <= {r.id for r in frame.filter("kind = 'b'").collect()}


def test_an_appended_index_equals_a_rebuilt_one(spark, path):
    rows = documents(400, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    grown = I.build(frame.filter("id < 150"), path, "id", "text", "kind", shards=4, width=16)
    files = grown.part("postings").inputFiles()
    for low, high in ((150, 300), (300, 10_000)):
        grown = I.append(grown, frame.filter(f"id >= {low} and id < {high}"), "id", "text", "kind")
    whole = I.build(frame, path + "2", "id", "text", "kind", shards=4, width=16)
    assert set(files) < set(grown.part("postings").inputFiles()) and grown.version == 2
    for kind, (n, length, mean) in whole.kinds.items():
        assert grown.kinds[kind] == (n, pytest.approx(length), pytest.approx(mean))
    for query in ("rare stone", "the cat", "dog"):
        assert rows_of(I.bm25(grown, query, 15)) == rows_of(I.bm25(whole, query, 15)) == brute(rows, query, 15)
        assert sorted(I.full_text(grown, query).collect()) == sorted(I.full_text(whole, query).collect())
    assert I.opened(spark, path).version == 2


def test_a_query_reads_its_terms_only(spark, path):
    rows = [(i, "a", f"word{i % 97} word{i % 89} other{i}") for i in range(3000)]
    index = I.build(spark.createDataFrame(rows, SCHEMA), path, "id", "text", "kind", shards=16)
    every = index.part("postings").inputFiles()
    asked = I.postings(index, ["word5"])
    scan = asked._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(term" in scan.toString() or "EqualTo(term" in scan.toString()
    read = asked.select(F.input_file_name().alias("f")).distinct().count()
    assert read < len(every) / 8
    assert "text" not in asked.columns and "docs" not in asked.groupBy("block").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_few_blocks_are_opened(spark, path):
    """One short text among long ones has the rare words, so the bound rules out all blocks but its own."""
    rows = [(i, "a", "common " * 40 + "filler " * (i % 7)) for i in range(2000)] + [(5000, "a", "rare common")]
    rows += [(6000 + i, "a", "nothing here") for i in range(2500)]
    index = I.build(spark.createDataFrame(rows, SCHEMA), path, "id", "text", "kind", width=32)
    of = I.weights(index, ["rare", "common"])
    weight = F.when(F.col("term") == "rare", of["rare"]).otherwise(of["common"])
    blocks = I.postings(index, ["rare", "common"]).withColumn("weight", weight)
    length = index.kinds["*"][1]
    kept = I.pruned(blocks, 1, length)
    assert kept.select("block").distinct().count() <= 2 < blocks.select("block").distinct().count()
    assert I.bm25(index, "rare common", 1, unpruned=0).first().id == 5000


def test_no_documents(spark, path):
    empty = I.build(spark.createDataFrame([], SCHEMA), path, "id", "text", "kind")
    assert I.bm25(empty, "cat", 3).count() == 0 and I.full_text(empty, "cat").count() == 0
    grown = I.append(empty, spark.createDataFrame([(1, "a", "cat")], SCHEMA), "id", "text", "kind")
    assert [r.id for r in I.bm25(grown, "cat", 3).collect()] == [1]


def test_lists_are_made_where_texts_are_read(spark):
    """Words aren't shuffled one by one: a task makes lists of a block, and equal terms of one folder go to one of several tasks."""
    frame = spark.createDataFrame(documents(100, 4), SCHEMA).repartition(2).selectExpr("id", "coalesce(kind, '') kind", "filter(split(lower(coalesce(text, '')), '[ \t]+'), w -> w != '') words")
    lists = I._lists(frame, 16)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the repartition above
    rows = lists.collect()
    assert len({(r.term, r.kind, r.block) for r in rows}) == len(rows) and max(r.n for r in rows) <= 16
    got = {(r.term, i, tf, size) for r in rows for i, tf, size in zip(r.ids, r.tfs, r.sizes, strict=True)}
    assert got == {(w, r.id, r.words.count(w), len(r.words)) for r in frame.collect() for w in r.words}
    dealt = I._dealt(lists, 4, 12).withColumn("task", F.spark_partition_id())
    assert {r.n for r in dealt.groupBy("term").agg(F.countDistinct("task").alias("n")).collect()} == {1}
    assert dealt.rdd.getNumPartitions() == 12
