import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def brute(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def binomial(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_query_equals_oracle_and_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    got = sorted(map(tuple, quality.query(spark, d).collect()))
    assert got == sorted(db.execute(quality.SQL).fetchall())
    if size == "sf0.1":
        assert sum(not r[-1] and not r[-2] for r in got) > 200  # cutoffs are admitted at this size
        return
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all((r[1], *r[2:-1]) == brute(texts[r[0]]) for r in got)


@pytest.mark.parametrize("p", [0.01, 0.3])
def test_binomial_is_exact(spark, p):
    pairs = [(n, k) for n in (0, 1, 5, 80, 1000) for k in (0, 1, 2, 7, 200) if k <= n]
    rows = spark.createDataFrame(pairs, "n long, k long").withColumn("c", quality.binomial_cdf(F.col("n"), F.col("k"), p)).collect()
    for r in rows:
        assert r.c == pytest.approx(binomial(r.n, r.k, p) if r.k < r.n * p else 1.0, rel=1e-9)
    large = spark.createDataFrame([(10_000_000, 98_000)], "n long, k long").select(quality.binomial_cdf(F.col("n"), F.col("k"), 0.01)).first()[0]
    assert 0 < large < 1e-8


def test_cutoffs_follow_the_labels(spark):
    words = " ".join(f"w{i}" for i in range(60))
    good, bad = words, words + " $$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$"
    rows = [(i, f"u{i} {bad if i % 4 == 0 else good}", "en" if i % 2 else None) for i in range(8000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(6000)] + [(None, 1), (5, None), (8, 0)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(frame, labels).collect()}
    assert [kept[i] for i, _, s in rows] == [i % 4 != 0 for i, _, s in rows]
    all_good = spark.createDataFrame([(i, 1) for i in range(8000)], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(frame.filter("lang is null"), all_good).collect())


def test_false_rejections_stay_below_alpha_on_rows_not_used(spark):
    rng = random.Random(1)
    for seed in range(3):
        spread = {"a": 0.02, "b": 0.2, "c": 0.6}
        rows = [(i, s, i, 1000, int(1000 * min(1.0, rng.expovariate(1 / spread[s]))), 0, int(100 * rng.random() ** 4), 10, 0, 100, 0, False) for i in range(12_000) for s in [rng.choice("abc")]]
        names = "doc_id long, stratum string, text_hash long, word_chars long, n_symbols long, n_capitals long, n_bangs long, n_lines long, n_dup_lines long, n_words long, n_repeat_words long, base_failed boolean"
        frame = spark.createDataFrame(rows, names)
        labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
        limits = {r.stratum: r for r in quality.cutoffs(frame, labels).collect()}
        assert sum(getattr(r, "symbols") is not None for r in limits.values()) >= 1
        for s, r in limits.items():
            fresh = [x for x in rows[6000:] if x[1] == s]
            lost = sum((r.symbols is not None and x[4] / 1000 > r.symbols) or (r.bangs is not None and x[6] / 100 > r.bangs) for x in fresh)
            assert lost / len(fresh) <= quality.ALPHA


def test_repeated_texts_count_once(spark):
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(i, words if i else words + " $$$$$$$$$$$$$$$$", "en") for i in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 3000)], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(frame, labels).collect())


def test_edge_rows(spark):
    long = " ".join(f"a{i % 50_000}" for i in range(200_000))
    data = [(1, None, "en"), (2, "", None), (3, " \n \x0b\n", "en"), (None, "a b c " * 30, "x"), (4, long, "en"), (4, long, "en"), (5, "ü #é\n\nü #é\nü #é x", "de"), (6, "a a a a", "de"), (7, "a b a b a", "de")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("stratum", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.judge(frame, none).collect()
    assert sorted((str(r[0]), *r[1:-1]) for r in rows) == sorted((str(i), *brute(t)) for i, t, _ in data)
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality.judge(frame.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
