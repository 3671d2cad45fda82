import random
import re

from pyspark.sql import functions as F

from tessera.operators import ranges, runs as R

TEXTS = "run string, step long, nth int, name string, text string, fixed boolean"


def played(rows):
    """Each run step by step, variables in a dict."""
    out, by_run = [], {}
    for r in rows:
        by_run.setdefault(r[0], []).append(r)
    for run, own in by_run.items():
        variables = {}
        for step in sorted({r[1] for r in own}):
            done = []
            for _, _, nth, name, text, fixed in sorted((r for r in own if r[1] == step), key=lambda r: r[2]):
                value = text
                if text is not None and not fixed:
                    value = re.sub(R.HOLE, lambda m: m[0] if variables.get(m[1]) is None else variables[m[1]], text)  # noqa: B023
                out.append((run, step, nth, name, value))
                done.append((name, value))
            variables.update((n, v) for n, v in done if n is not None)
    return sorted(map(str, out))


def test_values_equal_a_run_step_by_step(spark):
    rng = random.Random(1)
    rows = []
    for run in ("hot", *"abcdefgh"):
        names = ["x", "y", "z.w", "v"]
        for step in range(-1, 40 if run == "hot" else rng.randrange(3, 9)):
            for nth in range(rng.randrange(3)):
                text = rng.choice(["1", "plain", None, "<{{x}}>", "{{y}}{{ z.w}}", "{{z.w}}+{{x}}", "{{none}} {x} {{v}}", "{{v}}!", "{{{{x}}}}"])
                rows.append((run, step, nth, rng.choice([*names, None]), text, rng.random() < 0.3))
    got = R.resolved(spark.createDataFrame(rows, TEXTS).repartition(5)).collect()
    assert sorted(str(tuple(r)) for r in got) == played(rows)


def test_chains_of_values(spark):
    rows = [("r", i, 0, f"v{i % 3}", f"{{{{v{(i - 1) % 3}}}}}{i}" if i else "start ", False) for i in range(12)]
    got = {r.step: r.value for r in R.resolved(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[11] == "start " + "".join(str(i) for i in range(1, 12))


def test_extractors_and_earlier_responses(spark):
    steps = spark.createDataFrame([("r", 1, '{"a": {"b": [1, "two"]}}'), ("r", 2, "no json"), ("r", 3, None)], "run string, step long, body string")
    two = F.array(F.struct(F.lit("x").alias("name"), F.lit("$.a.b[1]").alias("path")), F.struct(F.lit("y").alias("name"), F.lit("$.q").alias("path")))
    assert [(r.step, r.name, r.text) for r in R.extracted(steps.withColumn("extractors", two)).orderBy("step", "nth").collect()] == [(1, "x", "two"), (1, "y", None), (2, "x", None), (2, "y", None), (3, "x", None), (3, "y", None)]
    asks = spark.createDataFrame([("r", 2, 1, "$.a.b[0]"), ("r", 1, 1, "$.a.b[0]"), ("r", 3, 9, "$.a"), ("q", 3, 1, "$.a")], "run string, step long, source_step long, path string")
    assert sorted((r.run, r.step, r.value) for r in R.responses_before(asks, steps).collect()) == [("q", 3, None), ("r", 1, None), ("r", 2, "1"), ("r", 3, None)]


def test_a_hot_group_is_split(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', string(id % 40)) as k", "id", "if(id % 11 = 0, id, null) as v").repartition(6)
    got = {r.id: r.l for r in ranges.last_before(rows, ["k"], ["id"], F.col("v"), "l").collect()}
    last = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        assert got[r.id] == last.get(r.k)
        if r.v is not None:
            last[r.k] = r.v
