import random

from tessera.llm import secrets
from tests.llm.test_secrets import pairs_of

rng = random.Random(11)
WORDS = ["".join(rng.choice(["an", "er", "lich", "tion", "ou", "keit"]) for _ in range(7)) for _ in range(2000)]
MODEL = secrets.Model({k: secrets.specimens(k) for k in secrets.FORMATS}, pairs_of(WORDS))
TOKEN = "".join(p if not n else "".join(rng.choices(p, k=n)) for p, n in secrets.FORMATS["github"])


def test_tokens_within_runs_are_found():
    for before, after in [("", ""), ("", "."), ("", "..."), ("key=", ""), ("https://h/", ""), ("//host.example/path/", "/more.html"), ("x", ""), ("key=", "=")]:
        run = before + TOKEN + after
        part = run[run.rfind(":") + 1 :]
        at = part.index(TOKEN)
        assert (at, at + len(TOKEN), "github") in [x[:3] for x in MODEL.spans(part)]
    two = f"{TOKEN}/{TOKEN}."
    assert sorted(x[:3] for x in MODEL.spans(two)) == [(0, 40, "github"), (41, 81, "github")]
    assert not any(MODEL.spans(f"{a}.{b}/{a}") for a, b in zip(WORDS[:200], WORDS[200:400], strict=True))


def test_parts_beside_base_spans(spark):
    hexes = "0f" * 16
    text = f"see {TOKEN}/{hexes}.{TOKEN}. and https://h/{TOKEN}"
    base = sorted(secrets.base_spans(text))
    inside = [text[a:b] for a, b in secrets.parts_beside(text, base)]
    assert inside == [f"{TOKEN}/", f".{TOKEN}.", f"//h/{TOKEN}"]
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = secrets.scan(frame, MODEL).collect()
    at = [i for i in range(len(text)) if text.startswith(TOKEN, i)]
    assert set(row.spans.split(",")) == {f"hex:{text.index(hexes)}:{text.index(hexes) + 32}", *(f"github:{i}:{i + 40}" for i in at)}


def _token(kind: str) -> str:
    return "".join(p if not n else "".join(rng.choices(p, k=n)) for p, n in secrets.FORMATS[kind])


def test_joined_tokens_of_every_format():
    asked = right = 0
    for kind in secrets.FORMATS:
        for by in "+/_.=-":
            for n in (2, 5, 20, 50):
                tokens, at, want = [_token(kind) for _ in range(n)], 0, set()
                for t in tokens:
                    want.add((at, at + len(t), kind))
                    at += len(t) + 1
                got = MODEL.spans(by.join(tokens))
                assert got == sorted(got) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
                assert all(x[3] >= secrets.THRESHOLD for x in got)
                if kind == "jwt" and by in "-_":  # both stand within its own parts, so neighbours may be one span
                    assert {x[2] for x in got} == {kind} and sum(b - a for a, b, *_ in got) >= 0.9 * (at - 1)
                    continue
                asked += n
                right += len(want & {x[:3] for x in got})
    assert right >= 0.97 * asked


def test_formats_mixed_in_one_run_keep_their_kinds():
    kinds = [k for k in secrets.FORMATS if k != "jwt"] * 3
    rng.shuffle(kinds)
    tokens = [_token(k) for k in kinds]
    found = [x[2] for x in MODEL.spans("/".join(tokens))]
    assert sum(a == b for a, b in zip(found, kinds, strict=False)) >= len(kinds) - 1 and len(found) == len(kinds)


def test_automata_refuse_other_formats():
    for kind, automaton in MODEL.automata.items():
        for other in secrets.FORMATS:
            if other != kind:
                assert all(automaton.score(s) is None for s in secrets.specimens(other)[:50])


def test_time_is_linear_in_the_run():
    import time

    def took(n):
        run = "/".join(_token("npm") for _ in range(n))
        best = 9.0
        for _ in range(3):
            begin = time.process_time()
            assert sum(x[2] == "npm" for x in MODEL.spans(run)) >= 0.99 * n
            best = min(best, time.process_time() - begin)
        return best

    assert took(1600) < 4 * took(800)
