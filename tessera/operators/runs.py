"""Variables carried over the steps of scenario runs: who reads what, the last write before it, and values that hold templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ranges import last_before
from tessera.operators.rounds import settled
from tessera.operators.scenario import substitute

#: What a variable's name looks like in a template.
HOLE = r"\{\{(\w+(?:\.\w+)*)\}\}"
#: The step of variables that a run starts with.
START = -1


def extracted(steps: DataFrame, extractors: str = "extractors", body: str = "body") -> DataFrame:
    """``(run, step, nth, name, text, fixed)``: what extractors write: the value at their JSON path of a step's response, null if there is none.

    steps: (run, step, body, extractors) with an array of structs (name, path). A later extractor of a step overwrites an earlier one.
    """
    each = steps.select("run", "step", F.try_parse_json(F.col(body)).alias("b"), F.posexplode(extractors).alias("nth", "e"))
    return each.select("run", "step", "nth", F.col("e.name").alias("name"), F.try_variant_get("b", F.col("e.path"), "string").alias("text"), F.lit(True).alias("fixed"))


def responses_before(mappings: DataFrame, steps: DataFrame) -> DataFrame:
    """``mappings`` (run, step, source_step, path, ...) with ``value``: what an earlier step's response holds at the path; null for a step that isn't before, or isn't there."""
    bodies = steps.select("run", F.col("step").alias("source_step"), F.try_parse_json("body").alias("_b"))
    found = mappings.join(bodies, ["run", "source_step"], "left")
    return found.withColumn("value", F.when(F.col("source_step") < F.col("step"), F.try_variant_get("_b", F.col("path"), "string"))).drop("_b")


def resolved(texts: DataFrame) -> DataFrame:
    """``(run, step, nth, name, value)``: all texts with ``{{name}}`` replaced by what the variable holds before their step.

    texts: (run, step, nth, name, text, fixed). A row with a name sets that variable once its step is done, so a step sees
    the last write of an earlier step, by step and nth; ``START`` is the step of what a run begins with. fixed: the text is
    taken as it is. A variable that isn't set, or whose last write is null, leaves its place as it is, and what
    a value holds is not replaced again.

    The last write is found by one sort over all runs, in ranges, so a run of any share of the rows is split. Values that
    depend on other values are filled in rounds, as many as the longest chain of them is long: a round takes the texts whose
    variables are all known.
    """
    rows = settled(texts.select("run", "step", "nth", "name", "text", "fixed").withColumn("id", F.monotonically_increasing_id()))
    holes = F.array_distinct(F.regexp_extract_all("text", F.lit(HOLE), F.lit(1)))
    reads = rows.filter("not fixed and text is not null").select("run", "step", "id", F.explode(holes).alias("name"))
    used = settled(_sources(rows, reads))
    plain = rows.join(used.filter("source is not null").select("id").distinct(), "id", "left_anti")
    known = settled(plain.select("id", F.col("text").alias("value")))
    open_ = settled(rows.join(plain.select("id"), "id", "left_anti"))
    while not open_.isEmpty():
        has = used.filter("source is not null").join(open_.select("id"), "id", "left_semi").join(known.select(F.col("id").alias("source"), "value", F.lit(True).alias("there")), "source", "left")
        ready = has.groupBy("id").agg(F.count("*").alias("n"), F.count("there").alias("m"), F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value"))).alias("values")).filter("n = m")  # as many as a text has names
        now = settled(open_.join(ready, "id").select("id", substitute(F.col("text"), F.map_from_entries("values")).alias("value")))
        known = known.union(now)
        open_ = settled(open_.join(now.select("id"), "id", "left_anti"))
    return rows.join(known, "id").select("run", "step", "nth", "name", "value")


def _sources(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """``(id, name, source)`` of reads: the id of the last write of the variable in an earlier step of the run, null if there is none."""
    none: Column = F.lit(None).cast("long")
    writes = rows.filter("name is not null").select("run", "name", "step", F.lit(1).alias("kind"), "nth", F.col("id").alias("by"), F.col("id").alias("write"))
    # of rows of a step the reads come first, so that they see only what earlier steps wrote
    asked = reads.select("run", "name", "step", F.lit(0).alias("kind"), F.lit(0).alias("nth"), F.col("id").alias("by"), none.alias("write"))
    both = last_before(writes.union(asked), ["run", "name"], ["step", "kind", "nth", "by"], F.col("write"), "source")
    return both.filter("kind = 0").select(F.col("by").alias("id"), "name", "source")
