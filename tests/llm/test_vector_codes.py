import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes as v
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
NONE, INF, NAN = None, float("inf"), float("nan")


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in Python's whole numbers: rows of (vec_id, code, error, label_error, codebooks_sha256)."""
    kept = [(i, [math.floor(4096 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = -(-len(kept[0][1]) // parts)
    cut = [(i, [(e + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)], label) for i, e, label in kept]
    books = [[c[1][p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, c, _ in cut:
                held[near(c[p], book)[1]].append(c[p])
            books[p] = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, book, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, by = [], {}
    for i, c, label in cut:
        found = [near(c[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), v.LONGEST)
        by[label] = by.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(str((i, code, error, min(by[label], v.LONGEST), sha)) for i, code, error, label in out)


def got(frame):
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in frame.collect())


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    frame = v.query(spark, FOLDER).cache()
    assert got(frame) == brute(rows)
    assert oracle.rows(frame.toPandas()) == oracle.rows(oracle.database(FOLDER).execute(v.SQL).df())


def test_blocks_of_any_size_give_the_same(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)], rng.choice([1, 2, None])) for i in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for size, parts in ((4096, 1), (7, 5), (64, 3)):
        assert got(v.compress(frame.repartition(parts), block_rows=size)) == want


def edge_rows():
    rows = [(i % 40, [float((i * k * 7) % 11) / 8 - 0.5 for k in range(10)], i % 3 or None) for i in range(90)]
    bad = [NONE, [NONE] * 10, [0.5] * 9 + [NAN], [INF] + [0.0] * 9, [-INF] * 10, [0.1] * 9 + [NONE]]
    return [*rows, *((100 + i, x, 1) for i, x in enumerate(bad)), (None, [0.25] * 10, None), (None, [0.25] * 10, 5)]


def test_edge_rows(spark):
    rows = edge_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.withColumn("id", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("code", F.lit(2)).withColumn("of", F.lit(3)).repartition(4)
    assert got(v.compress(clash)) == brute(rows)
    short = [(900, [1.0] * 3, 1), (901, [], 1)]
    assert got(v.compress(frame.union(spark.createDataFrame(short, SCHEMA)))) == brute(rows)
    assert v.compress(frame.limit(0)).count() == 0
    assert v.compress(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    few = rows[:5]
    assert got(v.compress(spark.createDataFrame(few, SCHEMA))) == brute(few)


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(v, "BROADCAST_LABELS", 0)
    rows = edge_rows()
    assert got(v.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("size", [1e3, 1e9, 1e30])
def test_large_components_stay_exact(spark, size):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(8)], i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(v.compress(frame)) == brute(rows)


def test_ids_that_are_texts(spark):
    frame = spark.createDataFrame([("b", [0.1] * 8, "x"), ("a", [0.9] * 8, None)], "key string, e array<double>, kind string")
    rows = v.compress(frame, id_col="key", vector_col="e", label_col="kind").collect()
    assert {(r.vec_id, r.code) for r in rows} == {("a", "00" * 8), ("b", "01" * 8)} and all(r.error == 0 for r in rows)


def test_codes_tell_vectors_apart(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    data = [(i, (centres[i % 10] + rng.normal(scale=0.02, size=32)).tolist(), i % 10) for i in range(400)]
    learned = v.Quantiser(spark.createDataFrame(data, SCHEMA))
    by = {}
    for r in learned.codes().collect():
        by.setdefault(r.label, []).append(r.error)
    spread = 4096**2 * 32
    assert max(max(e) for e in by.values()) < spread * 0.02  # far below the spread of the centres
