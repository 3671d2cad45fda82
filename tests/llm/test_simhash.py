import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def brute_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(seed, n=300):
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(n // 20):
        at = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(20):
            found.append(at)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                at ^= 1 << int(b)
    return list(dict.fromkeys(found))


@pytest.mark.parametrize("bucket_rows", [1_000_000, 10])
def test_links_equal_brute_force(spark, bucket_rows):
    for seed in range(2):
        fps = clustered(seed)
        frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        label = {r.node: r.label for r in connected_components(simhash.links(frame, bucket_rows=bucket_rows, chunk_rows=50), "a", "b").collect()}
        mine = [label.get(signed(x), signed(x)) for x in fps]
        want = brute_components(fps)
        groups = {}
        for m, w in zip(mine, want, strict=True):
            assert groups.setdefault(m, w) == w
        assert len(groups) == len(set(want))


def test_trie_walk_equals_brute_force_on_dense_groups():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    bits = np.unique(np.array([base ^ np.uint64(int(x)) for x in rng.integers(0, 1 << 14, 600)], dtype=np.uint64))
    label = simhash.trie_links(bits, [np.array([0]), np.array([len(bits)]), np.array([0]), np.array([len(bits)])], 2)
    want = brute_components([int(b) for b in bits], 2)
    assert len({*zip(label.tolist(), want, strict=True)}) == len(set(want)) == len(set(label.tolist()))


def test_query_equals_brute_force(spark):
    rows = simhash.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = {i: ids[c] for i, c in zip(ids, brute_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps, strict=True)}


def test_edge_rows(spark):
    long = "wörd next " * 30_000
    data = [(3, None), (2, ""), (7, " \n\t"), (5, "same text"), (4, "same text"), (4, "same text"), (None, "same TEXT"), (9, long), (8, None), (None, "alone among these")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("label", F.lit(1))
    rows = simhash.near_duplicates(frame).collect()
    assert len(rows) == len(data)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert got[3, zero] == got[2, zero] == got[7, zero] == got[8, zero] == 2
    assert {c for (i, f), c in got.items() if f == f"{brute_fingerprint('same text'):016x}"} == {4}
    assert got[9, f"{brute_fingerprint(long):016x}"] == 9
    assert got[None, f"{brute_fingerprint('alone among these'):016x}"] is None
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    kept = sorted((str(r.doc_id), r.text) for r in simhash.deduplicate(frame).collect())
    assert kept == sorted([("2", ""), ("4", "same text"), ("9", long), ("None", "alone among these")])
    assert simhash.deduplicate(frame.limit(0)).count() == 0


def test_hot_fingerprints_are_salted_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    data = [(i, "the same text of some words" if i % 3 == 0 else f"text {i} of words {i * 7} {i * 11}", {"k": i}, "x") for i in range(300)] + [(None, None, {"n": 1}, "y")] * 40
    frame = spark.createDataFrame(data, "doc_id long, text string, _hash map<string,int>, `_id` string").withColumns({"salt": F.lit(1), "fp": F.lit(2), "row": F.lit(3), "n": F.lit(4), "hash": F.lit(5)})
    rows = simhash.near_duplicates(frame).collect()
    texts = [t for _, t, *_ in data]
    label = brute_components([brute_fingerprint(t) for t in texts])
    least = {}
    for (i, *_), c in zip(data, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == sorted((str(i), str(least[c])) for (i, *_), c in zip(data, label, strict=True))
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in least.values())


def test_large_tries_are_cut_again_and_again(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = list(dict.fromkeys(int(base ^ int(x) ^ (int(y) << 40)) for x, y in zip(rng.integers(0, 1 << 12, 400), rng.integers(0, 1 << 10, 400), strict=True)))
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    tries = simhash._tries(frame, 4, 8)
    sizes = [r["count"] for r in tries.groupBy("path", "prefix").count().collect()]
    assert max(sizes) <= 8
    label = {r.node: r.label for r in connected_components(simhash.links(frame, bucket_rows=8), "a", "b").collect()}
    want = brute_components(fps)
    assert len({*zip([label.get(signed(x), signed(x)) for x in fps], want, strict=True)}) == len(set(want)) == len({label.get(signed(x), signed(x)) for x in fps})
