"""Operator 3, benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words joined by one blank. An item of m
characters may be found with up to ``max_error_rate * m`` edits (rounded down): cut it into one
piece more than that, and each occurrence within the budget holds at least one piece unchanged,
shifted by no more than the budget. All pieces of all items form one Aho-Corasick automaton. Each
exact piece hit gives a window of the text in which Myers' bit-parallel algorithm finds the least
edit distance of the item to any part of the window.

Items are broadcast in slices of at most ``slice_chars`` characters, so a benchmark of any size
works, with one pass over the texts per slice; a worker builds the automaton of a slice once. An
item with a budget of edits may be found inside words, as an edit may be at its ends; one without
(of fewer than 1 / max_error_rate characters) counts only where its ends are ends of words.

Nulls: a null text or item counts as empty; items without a word match nothing. A null item_id
stays as it is. Repeated items are one row per item_id each; repeated documents give repeated
pairs. Texts of any length are searched whole, one at a time; a long item's windows overlap those
of its other pieces and are merged. Other columns are not read, or only returned by ``clean``,
whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, table

MAX_ERROR_RATE = 0.08
SLICE_CHARS = 8_000_000
_WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): the item in errors + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the part of text nearest to pattern, the first such end; None beyond the budget.

    The column of the edit matrix is held as two bit vectors of vertical differences in Python's
    integers, of any length; a part may begin anywhere, so the first row is zero.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = None
    for j, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, j)
            if not distance:
                break
    return best


def finder(items: list[tuple[int | None, str]], max_error_rate: float) -> Callable[[str], list[tuple[int, int, int, int]]]:
    """A function from a normalised text to (number of the item, distance, start of the window, end) of each item found."""
    import ahocorasick

    budgets = [int(max_error_rate * len(t)) for _, t in items]
    at: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(items):
        for start, piece in pieces(text, budgets[i]):
            at.setdefault(piece, []).append((i, start))
    automaton = ahocorasick.Automaton()
    for piece, owners in at.items():
        automaton.add_word(piece, (len(piece), owners))
    if not at:
        return lambda text: []
    automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int, int]]:
        windows: dict[int, list[list[int]]] = {}
        for end, (length, owners) in automaton.iter(text):
            for i, start in owners:
                first = end - length + 1 - start
                lo, hi = max(0, first - budgets[i]), first + len(items[i][1]) + budgets[i]
                spans = windows.setdefault(i, [])
                if spans and budgets[i] and abs(spans[-1][0] - lo) <= 2 * budgets[i]:  # hits of one occurrence: nearly the same window
                    spans[-1] = [min(spans[-1][0], lo), max(spans[-1][1], hi)]
                else:
                    spans.append([lo, hi])
        found = []
        for i, spans in windows.items():
            best = None
            for lo, hi in spans:
                if not budgets[i] and not (text[lo - 1 : lo] in " " and text[hi : hi + 1] in " "):
                    continue
                hit = myers(items[i][1], text[lo:hi], budgets[i])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo, lo + hit[1])
                    if not hit[0]:
                        break
            if best:
                found.append((i, *best))
        return found

    return find


class Items:
    """A slice of items with their rate of errors; what finds them is built once in each worker."""

    def __init__(self, items: list[tuple[int | None, str]], max_error_rate: float):
        self.items, self.rate = items, max_error_rate

    @cached_property
    def find(self) -> Callable[[str], list[tuple[int, int, int, int]]]:
        return finder(self.items, self.rate)


def _slices(benchmark: DataFrame, item_id: str, item_text: str, slice_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in slices of bounded size; one slice at a time is on the driver."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        text = normal(row.t)
        if held and size + len(text) > slice_chars:
            yield held
            held, size = [], 0
        if text:
            held.append((row.i, text))
            size += len(text)
    yield held


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_error_rate: float = MAX_ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, match_end)``: each item in each text within the budget, at its nearest.

    match_end: where the occurrence ends, in characters of the normalised text.
    """
    spark = documents.sparkSession
    docs = documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    found = None
    for items in _slices(benchmark, item_id, item_text, slice_chars):
        shared = spark.sparkContext.broadcast(Items(items, max_error_rate))  # slice_chars characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value.find
            for batch in batches:
                rows = [(d.as_py(), shared.value.items[i][0], distance, end) for d, t in zip(batch.column(0), batch.column(1), strict=True) for i, distance, _, end in find(normal(t.as_py()))]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "match_end"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, distance int, match_end long")
        found = part if found is None else found.union(part)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", max_error_rate: float = MAX_ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of documents that hold no item, all columns."""
    spark = documents.sparkSession
    at = documents.schema.fieldNames().index(text_col)
    item_id = F.lit(0).cast("long").alias("_item")
    for items in _slices(benchmark.select(item_id, F.col(item_text)), "_item", item_text, slice_chars):
        shared = spark.sparkContext.broadcast(Items(items, max_error_rate))  # slice_chars characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value.find
            for batch in batches:
                yield batch.filter(pa.array([not find(normal(t.as_py())) for t in batch.column(at)], type=pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
