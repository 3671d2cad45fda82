import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_score as lm


def words(text):
    return (text or "").encode().lower().split()


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """The model by dictionaries of tuples."""

    def __init__(self, rows):
        self.counts = Counter()
        training = [[*words(t), None] for i, t in rows if not out(i)]
        for ws in training:
            read = ["<s>", *ws]
            for n in (1, 2, 3):
                self.counts.update(tuple(read[i - n + 1 : i + 1]) for i in range(1, len(read)) if i - n + 1 >= 0)
        self.counts["<s>",] = len(training)
        self.words = [w for w in {w for ws in training for w in ws}]
        self.n = sum(map(len, training))
        each = Counter(self.counts[w,] for w in self.words)
        self.d = each[1] / (each[1] + 2 * each[2]) if each[1] and each[2] else 0.5

    def p(self, history, w):
        if not history:
            if not self.n:
                return 1.0
            c = self.counts[w,]
            return (c - self.d if c else self.d * len(self.words)) / self.n
        s, h = lm.STRENGTHS[len(history) - 1], self.counts[history]
        return (self.counts[*history, w] + s * self.p(history[1:], w)) / (h + s)

    def rows(self, rows):
        found = []
        for i, t in rows:
            ws, history, score = [*words(t), None], ("<s>",), 0.0
            for w in ws:
                score += math.log10(self.p(history, w))
                history = (*history, w)[-2:]
            base = sum(math.log10((self.counts[w,] + 1) / (self.n + len(self.words) + 1)) for w in ws)
            found.append((i, out(i), len(ws), sum(self.counts[w,] > 0 for w in ws), self.n, base, score))
        return found


def brute(rows):
    return Brute(rows).rows(rows)


def same(rows, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4], round(r[5], 4), round(r[6], 4))
    got = sorted((tuple(r) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize(("keys", "block"), [(lm.BUCKET_KEYS, lm.BLOCK_BYTES), (5_000, 20_000)])
def test_query_equals_brute_force(spark, keys, block):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = lm.score(documents, bucket_keys=keys, block_bytes=block).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_a_state_sum_to_one():
    rng = random.Random(0)
    model = Brute([(i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 9)))) for i in range(40)])
    for history in [(), ("<s>",), ("a",), ("a", "b"), ("<s>", "c"), ("zz",), ("a", "zz")]:
        assert sum(model.p(history, w) for w in [*model.words, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_packed_keys_and_counts_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm.unpacked(lm.packed(keys)) == keys).all()
        layout = lm.Layout(n, 50 * n, 10)
        for order in range(3):
            cut = layout.cut(order, keys)
            number = layout.bucket(order, cut)
            assert (np.diff(number.astype(np.int64)) >= 0).all() and (not n or int(number.max()) < 1 << layout.bits[order])
    assert lm.from_planes(lm.planes(np.array([0, 255, 1 << 40]))).tolist() == [0, 255, 1 << 40]


def test_edge_rows(spark):
    data = [(1, None), (2, ""), (2, ""), (3, "a A b"), (None, "a c"), (4, "z " * 50_000), (7, "a a a \x0b\n b"), *[(None, "a a b")] * 40]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("held_out", F.lit(5)).withColumn("counts", F.lit(1)).withColumn("held", F.lit(1))
    same(lm.score(frame, block_bytes=50).collect(), brute(data))
    assert lm.score(frame.limit(0)).count() == 0
    only = [(i, "x y") for i in range(50) if out(i)]
    same(lm.score(spark.createDataFrame(only, "doc_id long, text string")).collect(), brute(only))
