import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(text, threshold=licenses.THRESHOLD):
    w = words(text)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if " ".join(w[i : i + len(phrase.split())]) == phrase)
    met = []
    for family, label, must, never, t in licenses.TEMPLATES:
        length, own = len(words(t)), set(words(t))
        for lo in range(0, len(w), length):
            block = set(w[lo : lo + 2 * length])
            n = len(block & own)
            if n / len(own) >= threshold - 1e-12 and block >= set(must.split()) and not block & set(never.split()):
                met.append((family, label, lo, lo + 2 * length, n, n / len(own)))
    kept = [m for m in met if not any(o[0] == m[0] and o[4] > m[4] and o[2] < m[3] and m[2] < o[3] for o in met)]
    best = max((m[5] for m in kept), default=0.0)
    met = {m[1] for m in kept}
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), 1.0 if at else best


def check(rows, data):
    got = sorted((str(r.doc_id), *tuple(r)[1:-1], round(r.score, 9)) for r in rows)
    want = sorted((str(i), *brute(t)[:-1], round(brute(t)[-1], 9)) for i, t in data)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    check(licenses.query(spark, d).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_edge_rows(spark):
    bsd = next(t[4] for t in licenses.TEMPLATES if t[4].startswith("Redistribution"))
    parts = bsd.split(" ")
    data = [
        (1, None), (2, ""), (3, " \n\n."), (None, "Under the MIT License."), (4, "UNDER\nthe--mit\tlicense under the mit license"), (4, "Apache License, Version 2 and CC BY-NC"),
        (5, bsd), (6, " ".join(parts[3:])), (7, " ".join(parts[8:])), (8, "x " * 60_000 + bsd + "\nyes"), (9, "\n".join(parts)), (5, bsd), (10, "Ünder the mit license ünder ＭＩＴ"), (11, "under the mit licenseé"), (None, bsd),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("word", F.lit("x")).withColumn("s", F.lit("x"))
    check(licenses.scan(frame).collect(), data)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labels_tell_licenses_apart_and_wrapped_texts_are_found(spark):
    mit = "\n".join(t[4] for t in licenses.TEMPLATES if t[1] == "mit" and len(t[4]) > 100)
    wrapped = "\n".join(textwrap.wrap(mit, 40))
    data = {
        1: ("Released under the BSD License.", "bsd"),
        2: ("Licensed under the Eclipse License, Version 2.0.", ""),
        3: ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        5: ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        6: ("prose " * 300 + wrapped + " prose" * 300, "mit"),
        7: ("Some words. All rights reserved.", "all-rights-reserved"),
        8: ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        9: ("all of the rights of way", ""),
        11: (("license software permission copyright notice granted free charge public version general " * 4000) + wrapped, None),
        10: ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in data.items()], "doc_id long, text string")
    rows = licenses.scan(frame).collect()
    assert {r.doc_id: r.labels for r in rows if r.doc_id != 11} == {i: x for i, (_, x) in data.items() if i != 11}
    check([r for r in rows if r.doc_id == 11], [(11, data[11][0])])


def test_many_licenses_in_a_text_take_linear_time(spark):
    """Of n, 2n and 4n paragraphs; planning, which is the same for all, counts in none."""
    paragraphs = "\n".join(t[4] for t in licenses.TEMPLATES if t[1] == "mit" and len(t[4]) > 100)

    def took(n):
        rows = licenses.scan(spark.createDataFrame([(1, "\n".join([paragraphs] * n))], "doc_id long, text string"))
        best = 1e9
        for _ in range(3):
            begin = time.perf_counter()
            assert [r.labels for r in rows.collect()] == ["mit"]
            best = min(best, time.perf_counter() - begin)
        return best

    took(50)
    one, two, four = took(400), took(800), took(1600)
    assert two < 2.8 * one and four < 2.8 * two


def test_repeated_and_overlapping_matches_equal_brute_force(spark):
    notices = [t[4] for t in licenses.TEMPLATES if t[0] in ("mit", "gpl", "reserved", "cc")]
    texts = [" ".join(notices * 3), "\n".join(n for n in notices for _ in range(4)), "all rights reserved " * 400, " ".join(" ".join(n.split()[1:]) for n in notices * 2)]
    data = list(enumerate(texts))
    check(licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect(), data)
