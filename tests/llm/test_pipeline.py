from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mix, toxicity
from tests.llm.test_mix import brute as copies
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_token_codec import crc, direct


def test_pipeline_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(documents, labels).collect() if r.predicted}
    docs = {i: x for i, x in docs.items() if i not in toxic}
    docs = {i: docs[i] for i in brute_kept({i: t for i, (t, _) in docs.items()})}
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    find = decontaminate.finder(items, decontaminate.MAX_ERROR_RATE)
    docs = {i: x for i, x in docs.items() if not find(decontaminate.normal(x[0]))}
    sizes = Counter(s for _, s in docs.values())
    share = {s: n**mix.TEMPERATURE for s, n in sizes.items()}
    mixed = [i for i in sorted(docs) for _ in range(copies(i, len(docs) * share[docs[i][1]] / sum(share.values()) / sizes[docs[i][1]]))]
    want, start = [], 0
    for i, x in zip(mixed, direct([docs[i][0] for i in mixed]), strict=True):
        want.append((i, start, len(x), crc(x)))
        start += len(x)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == want


def test_stages_take_nulls_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    frame = spark.createDataFrame([(1, None, None, None, None), (None, "a few words", "en", "s", 3), (1, "", "en", "s", 0), (None, "a few words", "en", "s", 3)], spark.read.parquet(f"{d}/documents.parquet").schema)
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.schema.names == frame.schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_stages_take_long_texts_ties_and_clashing_names(spark):
    d = "/root/testdata/sf0.001"
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (None, "", None, None, None), (3, "some other text of ten words that stands alone here", "en", "s", 3)]
    frame = spark.createDataFrame(rows, spark.read.parquet(f"{d}/documents.parquet").schema)
    docs = frame.withColumns({c: F.lit(c) for c in ("_id", "_hash", "_n", "_steps", "row", "tie", "salt", "id", "hash", "label", "fp", "set_hash", "total")})
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns[5:] == ["_id", "_hash", "_n", "_steps", "row", "tie", "salt", "id", "hash", "label", "fp", "set_hash", "total"]
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 3]
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, d)
    assert mixed.columns == docs.columns and corpus_pipeline.STAGES[4][1](spark, mixed, d).count() == mixed.count()
