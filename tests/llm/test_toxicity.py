import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox


def test_folding():
    assert tox.fold("1d10t ІDІОТ idi​ot ïdíöt idi0t") == ["idiot"] * 5
    assert tox.fold("in 2024, 100%%% of$$$ p@thetic") == ["in", "2024", "100", "of", "pathetic"]
    assert tox.fold(None) == tox.fold("") == tox.fold(" .,\n") == []


def test_matching_whole_words_and_exceptions():
    total = tox.matcher({"trash": 2.0, "idiot": 3.0}, ("trash can",))
    assert total(tox.fold("Trash idiot idiot trashy.")) == 8.0
    assert total(tox.fold("the trash can, trash")) == 2.0
    assert tox.matcher({}, ())(["x"]) == 0.0


def test_other_scripts_stay_and_exceptions_are_learned(spark):
    assert tox.fold("Straße και жизнь") == ["straße", "kai", "жизнь"] and tox.fold("pаthetic") == ["pathetic"]
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choices(["some", "plain", "words", "of", "prose", "and", "more"], k=20))
    texts = [(i, f"{filler()} you idiot {filler()}" if i % 2 else f"{filler()} the idiot novel {filler()}" if i % 24 == 0 else filler()) for i in range(1, 600)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = tox.fit(frame, labels)
    assert "idiot novel" in model.exceptions and "the idiot" in model.exceptions
    fresh = spark.createDataFrame([(1, "so he read the idiot novel again"), (2, "what an idiot you are")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in tox.score(fresh, model).orderBy("doc_id").collect()] == [False, True]


def brute_score(model, text):
    """The score by trying every term and phrase at every word."""
    words = tox.fold(text)
    covered = {i + k for e in model.exceptions for i in range(len(words)) if words[i : i + len(e.split(" "))] == e.split(" ") for k in range(len(e.split(" ")))}
    total = 0.0
    for i, w in enumerate(words):
        weights = [x for t, x in model.weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
        if weights and i not in covered:
            total += max(weights)
    return 1 / (1 + math.exp(-(total / max(len(words), 1) ** model.power * model.slope + model.offset)))


def test_scores_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tox.fit(documents, labels)
    model.exceptions = (*model.exceptions, *[f"{t} the" for t in list(model.weights)[:3] if not t.endswith("*")])
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = tox.score(documents, model).collect()
    assert len(rows) == len(texts) and model.weights
    for r in rows:
        assert r.score == pytest.approx(brute_score(model, texts[r.doc_id]), abs=1e-9)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tox.query(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[x.doc_id].predicted, x.toxic) for x in labels if rows[x.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9
    assert hit / sum(p for p, _ in held) > 0.95


def test_edge_rows(spark):
    data = [(i, "some idiot text" if i % 3 == 0 else f"some clean text {i}") for i in range(1, 200)]
    data += [(None, "idiot"), (500, None), (501, ""), (501, ""), (502, "idiot " * 50_000)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 150)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    rows = tox.toxicity(frame, labels).collect()
    assert len(rows) == len(data)
    by = {r.doc_id: r for r in rows}
    assert by[None].predicted == 1 and not by[None].held_out and by[198].predicted == 1 and by[502].predicted == 1
    assert by[500].score == by[501].score < 0.5
    assert sorted(r.doc_id for r in tox.reject(frame, labels).collect()) == sorted(r.doc_id for r in rows if r.predicted == 0)
    none = tox.toxicity(frame, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert tox.toxicity(frame.limit(0), labels).count() == 0


def test_an_exception_equal_to_a_term_covers_it():
    assert tox.matcher({"trash": 2.0}, ("trash",))(["trash"]) == 0
    assert tox.matcher({"trash": 2.0, "tra*": 3.0}, ("trash",))(["trash", "tramp"]) == 3.0
    assert tox.matcher({"trash": 2.0}, ("trash can",))(["trash", "trash", "can"]) == 2.0


def test_covered_terms_take_linear_time():
    import time

    total = tox.matcher({"trash": 2.0}, ("trash can",))
    took = []
    for n in (20_000, 80_000):
        words = ["trash", "can"] * n
        began = time.process_time()
        assert total(words) == 0
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2
