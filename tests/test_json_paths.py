import json
import random

import pytest

from tessera.operators import json_paths as J


def children(v):
    return list(v.items()) if isinstance(v, dict) else [(i, x) for i, x in enumerate(v)] if isinstance(v, list) else []


def below(v):
    yield v
    for _, x in children(v):
        if isinstance(x, (dict, list)):
            yield from below(x)


def brute(value, steps):
    """Steps as (descent, test of (parent, key, child))."""
    found = [value]
    for deep, test in steps:
        nodes = [n for v in found for n in (below(v) if deep else [v])]
        found = [x for n in nodes for k, x in children(n) if test(n, k, x)]
    return found


NAME = lambda name: lambda n, k, x: isinstance(n, dict) and k == name
AT = lambda i: lambda n, k, x: isinstance(n, list) and k == (i if i >= 0 else len(n) + i)
ANY = lambda n, k, x: True
PATHS = {
    "$.a": [(0, NAME("a"))],
    "$.a.b": [(0, NAME("a")), (0, NAME("b"))],
    "$.a[0]": [(0, NAME("a")), (0, AT(0))],
    "$['a'][-1]": [(0, NAME("a")), (0, AT(-1))],
    "$.*": [(0, ANY)],
    "$[*].b": [(0, ANY), (0, NAME("b"))],
    "$..b": [(1, NAME("b"))],
    "$..*": [(1, ANY)],
    "$..a[1]": [(1, NAME("a")), (0, AT(1))],
    "$.c..a": [(0, NAME("c")), (1, NAME("a"))],
    "$..[?(@.b > 2)]": [(1, lambda n, k, x: isinstance(x, dict) and type(x.get("b")) in (int, float) and x["b"] > 2)],
    "$.a[?(@.c == 'x')].b": [(0, NAME("a")), (0, lambda n, k, x: isinstance(x, dict) and x.get("c") == "x"), (0, NAME("b"))],
}


def made(rng, depth):
    if depth and rng.random() < 0.75:
        if rng.random() < 0.6:
            return {k: made(rng, depth - 1) for k in rng.sample(["c", "a", "b", "d e"], rng.randint(0, 4))}
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([0, 1, 3, -2, 2.5, "x", "", '{"a":1}', "[1]", "null", True, False, None, "ü\n\"q\""])


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(4)
    return [made(rng, 6) for _ in range(300)] + [{"a": [{"c": rng.choice(["x", "y", 1]), "b": made(rng, 1)} for _ in range(3)]} for _ in range(30)]


@pytest.mark.parametrize("path", sorted(PATHS))
def test_matches_equal_brute_force(spark, bodies, path):
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "key long, body string")
    got = {}
    for r in sorted(J.matches(frame, path).collect(), key=lambda r: (r.key, r.at)):
        got.setdefault(r.key, []).append(json.loads(r.text))
    want = {i: f for i, b in enumerate(bodies) if (f := brute(b, PATHS[path]))}
    assert len(want) > 3 and got == want


def test_first_match_of_any_depth_and_odd_bodies(spark):
    deep = {"b": "end"}
    for _ in range(40):
        deep = {"x": [deep]}
    data = [(1, json.dumps(deep)), (2, None), (3, ""), (4, "no json"), (5, '{"b": null}'), (6, ' {"z": {"b": 1}, "b": [2, {"b": 3}]}'), (7, '{"b": 1, "b": 2}'), (8, "3"), (9, '{"b": "q"}'), (9, '{"b": "q"}')]
    frame = spark.createDataFrame(data, "key long, body string")
    assert {r.key: r.value for r in J.first(frame, "$..b").collect()} == {1: "end", 5: None, 6: '[2,{"b":3}]', 9: "q"}
    assert J.first(frame.limit(0), "$..b").count() == 0


def test_what_is_no_path_is_refused():
    for path in ("", "a", "$a", "$.", "$.a[", "$[?(@.a ~ 1)]", "$.a..", "$[?(a > 1)]"):
        with pytest.raises(ValueError):
            J.steps_of(path)


def test_matches_are_written_as_spark_writes_them(spark):
    """Numbers keep all digits, objects their order, and no job but the caller's own runs on the way."""
    odd = ['{"z": 0.12345678901234567890123, "b": {"y": "ü\\u00fc", "x": [2.50, 1e3, -0]}}', '{"b": 10.0}', '{"b": "\\ud800"}', '{"b": {"a": "\\ud83d\\ude00"}} ', '{"c": [{"b": 12345678901234567890}]}']
    frame = spark.createDataFrame(list(enumerate(odd)), "key long, body string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("walk", "walk")
    found = J.matches(frame, "$..*")
    assert len(tracker.getJobIdsForGroup("walk")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.key, tuple(r.at)): r.text for r in found.collect()}
    assert got[0, (-1, 0)] == "0.12345678901234567890123" and got[0, (-1, 1)] == '{"y":"üü","x":[2.5,1000.0,0]}'
    assert got[1, (-1, 0)] == "10" and got[3, (-1, 0)] == '{"a":"\\uD83D\\uDE00"}' and got[4, (0, 0, -1, 0)] == "12345678901234567890"
