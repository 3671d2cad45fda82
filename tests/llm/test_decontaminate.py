import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate as dec


def distance(pattern, text):
    """(least distance to a part of text, its first end), by the plain matrix."""
    row = list(range(len(pattern) + 1))
    best = (len(pattern) + len(text), 0)
    for j, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, (row[-1], j))
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=20), st.text("ab c", max_size=40), st.integers(0, 6))
def test_myers_equals_matrix(pattern, text, budget):
    d, end = distance(pattern, text)
    found = dec.myers(pattern, text, budget)
    assert found == ((d, end) if d <= budget and end else None)


def test_finder_equals_matrix():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 14)))) for i in range(12)]
    find = dec.finder(items, 0.15)
    seen = 0
    for _ in range(150):
        text = " ".join(word() for _ in range(30))
        for i, t in rng.sample(items, 2):
            t = list(t)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(["", "a", "bc", " "])
            at = rng.randrange(len(text))
            text = text[:at] + "".join(t) + text[at:]
        want = {i: distance(t, text)[0] for i, t in items if distance(t, text)[0] <= int(0.15 * len(t))}
        assert {i: d for i, d, _, _ in find(text)} == want
        seen += len(want)
    assert seen > 50


def test_query_finds_every_exact_passage(spark):
    d = "/root/testdata/sf0.01"
    rows = {(r.doc_id, r.item_id) for r in dec.query(spark, d).collect()}
    items = [(r.item_id, dec.normal(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = [(r.doc_id, dec.normal(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    exact = {(i, k) for i, t in texts for k, x in items if x in t}
    assert exact and exact <= rows
    assert {i for i, _ in rows} == {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").join(dec.clean(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")), "doc_id", "left_anti").collect()}


def test_edge_rows(spark):
    item = "The quick brown fox, jumps over the lazy dog and runs away from it."
    data = [(1, item.upper()), (2, item.replace("lazy", "lzy")), (3, None), (4, ""), (None, f"x {item} y"), (5, "z " * 100_000 + item), (1, item.upper()), (6, "the quick brown fox")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("distance", F.lit(1))
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, " ,"), (None, item)], "item_id long, text string")
    for chars in (dec.SLICE_CHARS, 1):
        rows = sorted(((r.doc_id or 0, r.item_id or 0, r.distance) for r in dec.leaks(frame, bench, slice_chars=chars).collect()))
        assert rows == sorted((d, i, int(d == 2)) for d in (0, 1, 1, 2, 5) for i in (0, 10, 11))
        assert sorted(r.doc_id for r in dec.clean(frame, bench, slice_chars=chars).collect()) == [3, 4, 6]
    assert dec.leaks(frame.limit(0), bench).count() == dec.leaks(frame, bench.limit(0)).count() == 0
    assert dec.clean(frame, bench.limit(0)).count() == len(data)


def test_short_items_stand_alone_and_the_query_form_finds_edits(spark):
    words = [f"word{i} of text" for i in range(12)]
    item = " ".join(words)
    edited = item.replace("word3", "wrd3").replace("text word7", "text, Word7x")
    docs = spark.createDataFrame([(1, "the party of art"), (2, "a party"), (3, "Art!"), (4, f"before {edited} after"), (5, "x" * 300_000 + " " + edited), (6, item[:120])], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "art"), (11, item)], "item_id long, text string")
    want = {(1, 10), (3, 10)} | {(i, 11) for i, t in [(4, edited), (5, edited), (6, item[:120])] if distance(dec.normal(item), dec.normal(t))[0] <= int(dec.MAX_ERROR_RATE * len(dec.normal(item)))}
    got = dec.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) == 4
    texts = {r.doc_id: dec.normal(r.text) for r in docs.filter("doc_id < 5").collect()}
    for r in got:
        if r.doc_id < 5 and r.item_id == 11:
            assert r.distance == distance(dec.normal(item), texts[r.doc_id])[0]
    assert {r.doc_id for r in dec.clean(docs, bench).collect()} == {2, 6}
