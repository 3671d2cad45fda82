import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import secrets


def brute(text):
    """Base matches by the three patterns as stated, short ones dropped afterwards."""
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest(), [x for *_, x in sorted(found)]


def pairs_of(values):
    return Counter(p for v in values for p in zip([secrets.START, *v], [*v, secrets.END], strict=True))


def same(row, text):
    *counts, digest, spans = brute(text)
    assert [row.n_assign, row.n_access, row.n_hex, row.base_sha256] == [*counts, digest]
    assert [s for s in row.spans.split(",") if s.split(":")[0] in secrets.BASE and s in spans] == spans


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = secrets.query(spark, d).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 5
    for r in rows:
        same(r, texts[r.doc_id])


parts = st.sampled_from(["token", "API_KEY", "paſswd", "secret", "=", ":", " ", '"', "'", "abc", "token=abc", "AKIA", "Z9" * 6, "0f" * 8, "0f" * 16, "G", "\n", "é", "x" * 9])


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    found = sorted((a, k, f"{list(secrets.BASE)[k]}:{a}:{b}") for a, b, k, _ in secrets.base_spans(text))
    assert [x for *_, x in found] == brute(text)[-1]
    spans = sorted(secrets.base_spans(text))
    want = [m.span() for m in secrets.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, b, *_ in spans)]
    assert [m.span() for m in secrets.untouched(text, spans)] == want


def test_automaton_is_a_distribution_and_generalises():
    strings = ["ab" * n + "c" for n in range(1, 9) for _ in range(60 // n)]
    automaton = secrets.Automaton(strings)
    assert automaton.states < 8
    assert automaton.score("ab" * 30 + "c") is not None and automaton.score("ba") is None
    for log in automaton.log:
        assert abs(sum(map(lambda x: 2.718281828459045**x, log.values())) - 1) < 1e-9


def test_held_out_credentials_are_found_and_words_are_not():
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "er", "lich", "tion", "ou", "keit"]) for _ in range(7)) for _ in range(3000)]
    model = secrets.Model({k: secrets.specimens(k) for k in secrets.FORMATS}, pairs_of(words[:2000]))
    for kind, spec in secrets.FORMATS.items():
        fresh = ["".join(p if not n else "".join(rng.choices(p, k=n)) for p, n in spec) for _ in range(100)]
        assert sum((x := model.likelihood(s)) is not None and x[0] >= secrets.THRESHOLD and x[1] == kind for s in fresh) > 85
    assert not any((x := model.likelihood(w)) and x[0] >= secrets.THRESHOLD for w in words[2000:])


def brute_spans(model, s):
    """(score, start, end) of every substring between boundaries that an automaton accepts."""
    found = []
    for lo in range(len(s)):
        if lo and s[lo - 1] not in secrets.SEPARATORS and not s.startswith(secrets._LITERALS, lo):
            continue
        for hi in range(lo + 1, len(s) + 1):
            if hi < len(s) and s[hi] not in secrets.SEPARATORS and (s[hi - 1] in secrets.SEPARATORS or not s.startswith(secrets._LITERALS, hi)):
                continue
            for a in model.automata.values():
                at = 0
                for c in s[lo:hi]:
                    at = a.arc[at].get(c) if at is not None else None
                if at is not None and secrets.END in a.log[at]:
                    found.append((a.score(s[lo:hi]) - model.background(s[lo:hi]), lo, hi))
    return found


def brute_sum(spans, length, cost):
    """The largest sum that disjoint spans make, each less the cost."""
    best = [0.0] * (length + 1)
    for hi in range(1, length + 1):
        best[hi] = max([best[hi - 1], *(best[lo] + x - cost for x, lo, end in spans if end == hi)])
    return best[length]


def test_best_spans_equal_brute_force_and_bounds_lose_none():
    rng = random.Random(3)
    labelled = {k: secrets.specimens(k)[:100] for k in ("github", "slack")} | {"assign": [f"tk-{rng.randrange(10**9):09}-{rng.choice('abc')}" for _ in range(200)]}
    model = secrets.Model(labelled, pairs_of(["plainwordsofletters", "someotherword.html", "http//host/path-of-words"] * 50))
    pieces = [*labelled["github"][:5], *labelled["assign"][:20], "word", "/", ".", "=", "key=", "x", "tk-123456789-b", "tk-123-b", "xoxb-123"]
    hits = 0
    for _ in range(400):
        s = "".join(rng.choices(pieces, k=rng.randint(1, 4)))
        every = brute_spans(model, s)
        for cost in (secrets.OPENING, secrets.THRESHOLD):
            got = model.chosen(s, 0, len(s), cost)
            assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
            assert all(min((abs(x - g[3]) for x, lo, hi in every if (lo, hi) == g[:2]), default=9.0) < 1e-6 for g in got)
            assert abs(sum(g[3] - cost for g in got) - brute_sum(every, len(s), cost)) < 1e-5, s
        spans = model.spans(s)
        inside = [x for x in every if x[0] >= secrets.THRESHOLD + 1e-6 and all(x[2] <= a or b <= x[1] for a, b, *_ in spans)]
        assert not inside, s  # nothing over the threshold is left beside those found
        hits += bool(spans)
        assert not spans or model.promising([s, "word", s[:1] * 9]) [:1] == [s]
    assert 100 < hits < 400


def test_formats_learned_from_labelled_credentials_are_found_without_label(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice(["an", "er", "lich", "tion", "ou", "keit"]) for _ in range(rng.randint(3, 9))) for _ in range(n))
    make = lambda: "svc_" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=24))
    labelled = [(i, f'{words(30)} api_key = "{make()}" {words(30)}') for i in range(200)]
    bare = [(1000 + i, f"{words(30)} {make()} {words(30)}") for i in range(20)]
    clean = [(2000 + i, words(60)) for i in range(300)]
    frame = spark.createDataFrame(labelled + bare + clean, "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(frame).collect()}
    found = [i for i in rows if i >= 1000 and rows[i].spans]
    assert sum(i < 2000 for i in found) >= 19 and not [i for i in found if i >= 2000]
    for i, r in rows.items():
        assert len(r.scores.split(",")) == len(r.spans.split(","))
        if i >= 1000 and r.spans:
            assert float(r.scores) >= secrets.THRESHOLD


def test_long_values_shape_the_background_and_are_scanned(spark):
    token = secrets.specimens("github")[0]
    run = "Qx" * 5000
    model = secrets.fit(spark.createDataFrame([(1, run)], "doc_id long, text string"))
    frame = spark.createDataFrame([(1, run), (2, f"{run}/{token}")], "doc_id long, text string")
    assert model.pair("Q", "x") > -0.2
    assert [r.spans for r in secrets.scan(frame, model).orderBy("doc_id").collect()] == ["", f"github:10001:{10001 + len(token)}"]


def test_edge_rows(spark):
    github = secrets.specimens("github")[0]
    long = "word " * 50_000 + f"{github} token='abcdefgh1'" + " 0f" * 1000 + "0f" * 40
    data = [(1, None), (2, ""), (3, long), (3, long), (None, "AKIA" + "Z" * 12), (4, f"secret={secrets.specimens('stripe')[1]}"), (5, "password: short"), (6, "é" + "ab" * 16)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("h", F.lit(1))
    rows = secrets.scan(frame).collect()
    assert len(rows) == len(data)
    texts = dict(data)
    for r in rows:
        same(r, texts[r.doc_id])
    by = {r.doc_id: r for r in rows}
    assert f"github:250000:{250000 + len(github)}" in by[3].spans and by[4].spans == brute(texts[4])[-1][0]
    assert by[1].spans == by[2].spans == by[5].spans == ""
    assert secrets.scan(frame.limit(0)).count() == 0
