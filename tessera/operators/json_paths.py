"""JSON paths with wildcards, descent and comparisons: one walk over each body, in which only matches become rows.

A path is ``$`` and steps: ``.name`` or ``['name']``, ``[3]`` and ``[-1]``, ``.*`` or ``[*]``, ``..`` before a name, a star or a
bracket, and ``[?(@.a.b < 3)]``, which keeps the elements of an array (or values of an object) whose value at ``a.b`` compares so
with a number or a quoted text. A body is parsed once, in Arrow batches, and all steps are walked within its task: nothing is
shuffled or written, and a descent reaches any depth. Spark says which bodies are JSON, and how the texts of matches are written.

Nulls: a body that is null, or no JSON, or repeats a key within one object, matches nothing; a JSON null at the path is a match.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_STEP = re.compile(
    r"""(?P<deep>\.\.)?(?:\.?(?P<name>[^\s.\[\]'"*?()@$]+)|\.?(?P<star>\*)|\[\s*(?:(?P<index>-?\d+)|(?P<any>\*)|'(?P<quoted>[^']*)'|"(?P<double>[^"]*)"|"""
    r"""\?\(\s*@(?P<field>(?:\.[\w-]+)+)\s*(?P<operator>==|!=|<=|>=|<|>)\s*(?:(?P<number>-?\d+(?:\.\d+)?)|'(?P<text>[^']*)')\s*\))\s*\])"""
)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: Sorts a node before all that lies below it.
_HERE = -1


def steps_of(path: str) -> list[re.Match]:
    """The steps of a path; a path that isn't one raises ``ValueError``."""
    found, at = [], 1
    while path[:1] == "$" and at < len(path):
        step = _STEP.match(path, at)
        if not step or path[at] not in ".[":
            break
        found.append(step)
        at = step.end()
    if path[:1] != "$" or at < len(path):
        raise ValueError(f"not a JSON path: {path}")
    return found


class _Real(float):
    """A number with a fraction or exponent that keeps how it was written."""

    def __new__(cls, text: str) -> _Real:
        made = float.__new__(cls, text)
        made.text = text
        return made


_DECODER = json.JSONDecoder(parse_float=_Real, strict=False)


def _parsed(text: str) -> object:
    return _DECODER.raw_decode(text)[0]


def _written(value: object) -> str:
    """A value as JSON text; half of a surrogate pair stays escaped, for no UTF-8 can hold it."""
    if isinstance(value, _Real):
        return value.text
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text) else json.dumps(value, separators=(",", ":"))


def _children(value: object) -> Iterator[tuple[int, str | None, object]]:
    """``(nth, name, child)``: the values of an object or the elements of an array, in their order; name is None for elements."""
    if isinstance(value, dict):
        yield from ((i, name, child) for i, (name, child) in enumerate(value.items()))
    elif isinstance(value, list):
        yield from ((i, None, child) for i, child in enumerate(value))


def _below(value: object, at: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], object]]:
    """A node, and all objects and arrays that lie below it."""
    stack = [(at, value)]
    while stack:
        at, value = stack.pop()
        yield (*at, _HERE), value
        stack += [((*at, i), child) for i, _, child in _children(value) if isinstance(child, (dict, list))]


def _number(value: int | float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def _picked(step: re.Match, value: object) -> Iterator[tuple[int, object]]:
    """The children of a node that a step takes, with their places."""
    name = next((step[g] for g in ("name", "quoted", "double") if step[g] is not None), None)
    if name is not None:
        if isinstance(value, dict) and name in value:
            yield next(i for i, own in enumerate(value) if own == name), value[name]
    elif step["index"] is not None:
        n = int(step["index"])
        if isinstance(value, list) and -len(value) <= n < len(value):
            yield n % len(value), value[n]
    else:
        yield from ((i, child) for i, _, child in _children(value) if not step["field"] or _holds(step, child))


def _holds(step: re.Match, value: object) -> bool:
    """Whether the value at the step's field compares so with its number or text; a value of another type doesn't."""
    for name in step["field"].split(".")[1:]:
        if not isinstance(value, dict) or name not in value:
            return False
        value = value[name]
    compare = _COMPARE[step["operator"]]
    if step["number"] is not None:
        return isinstance(value, (int, float)) and not isinstance(value, bool) and compare(_number(value), float(step["number"]))
    return isinstance(value, str) and compare(value, step["text"])


def _walked(value: object, steps: list[re.Match]) -> Iterator[tuple[tuple[int, ...], object]]:
    """``(at, node)``: what a path matches in one body."""
    nodes = [((), value)]
    for step in steps:
        if step["deep"]:
            nodes = [n for at, v in nodes for n in _below(v, at)]
        nodes = [((*at, i), child) for at, v in nodes for i, child in _picked(step, v)]
    yield from nodes


def matches(bodies: DataFrame, path: str, key: str = "key", body: str = "body") -> DataFrame:
    """``(key, at, text)``: all matches as JSON texts; ``at`` sorts those of a body: a node's own before those below it, else as written."""
    read = bodies.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("at"), F.ltrim(F.regexp_replace(body, r"^\s+", "")).alias("text")).filter(F.try_parse_json("text").isNotNull())
    steps_of(path)
    if path == "$":
        return read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = steps_of(path)  # of the task: a match can't be sent
        for batch in batches:
            rows, at, texts = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for place, value in _walked(_parsed(text), steps):
                    rows.append(n)
                    at.append(place)
                    texts.append(_written(value))
            made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["key", "at", "text"])

    kind = read.schema["key"].dataType.simpleString()
    found = read.select("key", "text").mapInArrow(run, f"key {kind}, at array<int>, text string")
    inner = F.col("text").startswith("{") | F.col("text").startswith("[")
    plain = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.lit(0))
    return found.select("key", "at", F.when(inner, plain).otherwise(F.coalesce(F.to_json(F.try_parse_json("text")), F.lit("null"))).alias("text"))


def first(bodies: DataFrame, path: str, key: str = "key", body: str = "body") -> DataFrame:
    """``(key, value)``: of each key with a match its first, a text without its quotes, all else as JSON; a JSON null as null."""
    best = matches(bodies, path, key, body).groupBy("key").agg(F.min(F.struct("at", "text")).alias("m"))
    plain = F.try_variant_get(F.try_parse_json("m.text"), F.lit("$"), "string")
    return best.select("key", F.when(F.col("m.text").startswith('"'), plain).when(F.col("m.text") != "null", F.col("m.text")).alias("value"))
