"""Operator 6, toxicity by a learned weighted lexicon and Aho-Corasick matching.

Texts are folded first: compatibility forms and case, look-alike letters of other scripts,
accents laid over letters, zero-width marks, and digits or signs that stand for letters inside
a word. One automaton then finds all lexicon terms and all exception phrases in one pass; a term
inside an exception phrase does not count. A term is a whole word or a stem, written ``stem*``,
that begins words; of the terms at one word the heaviest counts. The sum of the weights is divided
by a power of the length in words, and a logistic curve turns it into a score.

Everything learned comes from labelled rows outside the held-out fold. Term weights are smoothed
log-odds of the share of toxic and clean texts that hold the term; a term is kept if its toxic
share is significantly the larger (z of ``MIN_Z``) and ``MIN_RATIO`` times the clean one. Exception
phrases are learned too: pairs of neighbouring words of which one is a term, held by a share of
clean texts that is larger likewise (z of ``EXCEPTION_Z``). The power and the curve are fitted on the same
rows. At most ``train_rows`` labelled rows are used (those least by a hash of doc_id), a documented
bound of the fit; a term is in at least ``MIN_SHARE`` of the toxic training rows, so the lexicon, which
is broadcast, grows with the words of a text, not with the corpus. Scoring covers every whole text.

Look-alike letters are folded in words that hold a Latin letter too, or that consist of them alone,
so words of other scripts stay as they are.

Nulls: a null text counts as empty and scores the curve's value at zero. A null doc_id is never
held out or trained on. Repeated rows are scored each. Labels with null or several values for a
document: the largest counts. Without both classes among the training rows the lexicon is empty
and all scores are the smoothed share of toxic rows. Texts of any length are scored whole. Other columns are not
read, or only returned by ``reject``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, first_rows, table, written

FOLDS, HELD_OUT = 5, 0
TRAIN_ROWS = 20_000
#: For terms, and for exception phrases, which are few.
MIN_Z, EXCEPTION_Z = 4.0, 2.5
MIN_RATIO = 8.0
MIN_SHARE = 0.005
#: Distinct terms that a task holds before it passes their counts on.
HELD = 300_000
#: Letters of the stems that are tried as terms beside whole words.
STEMS = range(4, 9)

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ø": "o", "ł": "l", "đ": "d",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_MAP = str.maketrans(LOOK_ALIKES)
_DROPPED = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_MARKS = re.compile("[̀-ͯ]+")
_LATIN = re.compile(r"[a-z]")
_WORD = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*")
_DIGITS = str.maketrans(SUBSTITUTES)
_HAS_SUBSTITUTE = re.compile(r"[0134578@$]")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str | None) -> list[str]:
    """The folded words of a text. Words without a letter keep their digits."""
    text = text or ""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text).lower().translate(_DROPPED))
    else:
        text = text.lower()
    words = _WORD.findall(text)
    if not text.isascii():
        words = [w if w.isascii() else like if (like := w.translate(_MAP)).isascii() or _LATIN.search(w) else w for w in words]
    if _HAS_SUBSTITUTE.search(text):
        words = [w.translate(_DIGITS) if _HAS_SUBSTITUTE.search(w) and _HAS_LETTER.search(w) else w for w in words]
    return words


def held_out(id_col: str, folds: int = FOLDS, fold_: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold_, F.lit(False))


def matcher(weights: dict[str, float], exceptions: Sequence[str]) -> Callable[[list[str]], float]:
    """A function from folded words to the sum of the weights of the terms in them."""
    import ahocorasick

    patterns: dict[str, tuple[bool, float | None]] = {}  # whether it is an exception, and its weight as a term
    for term, weight in weights.items():
        patterns[f" {term[:-1]}" if term.endswith("*") else f" {term} "] = (False, weight)
    for phrase in exceptions:
        folded = " ".join(fold(phrase))
        if folded:
            pattern = f" {folded} "
            patterns[pattern] = (True, patterns.get(pattern, (False, None))[1])
    if not patterns:
        return lambda words: 0.0
    automaton = ahocorasick.Automaton()
    for pattern, (exception, weight) in patterns.items():
        automaton.add_word(pattern, (len(pattern), exception, weight))
    automaton.make_automaton()

    def total(words: list[str]) -> float:
        terms: dict[int, float] = {}
        covered = []
        for end, (length, exception, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if exception:
                covered.append((start, end))
            if weight is not None:
                terms[start] = max(terms.get(start, weight), weight)
        covered.sort()
        ends = list(accumulate((d for _, d in covered), max))  # the furthest end of the ranges up to each
        starts = [c for c, _ in covered]

        def free(at: int) -> bool:
            before = bisect_right(starts, at)
            return not before or at >= ends[before - 1]

        return sum(w for at, w in terms.items() if free(at))

    return total


def _share_counts(training: DataFrame, found: Callable[[list[str]], set[str]]) -> DataFrame:
    """``(term, t, c)``: how many toxic and clean rows of ``(text, toxic)`` hold each thing that is found in their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in found(fold(text)):
                    counts.setdefault(term, [0, 0])[1 - mark] += 1
            if len(counts) > HELD:
                yield out(counts)
                counts = {}
        yield out(counts)

    def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
        terms = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(terms, type=pa.string()), *(pa.array([counts[x][i] for x in terms], type=pa.int64()) for i in (0, 1))], names=["term", "t", "c"])

    marked = training.select("text", F.col("toxic").cast("int").alias("toxic"))
    return marked.mapInArrow(run, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def terms_of(words: list[str]) -> set[str]:
    """The words and stems of a text."""
    distinct = set(words)
    return distinct.union(f"{w[:n]}*" for w in distinct for n in STEMS if len(w) > n)


def lexicon(training: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Term weights from ``(text, toxic)`` rows; toxic and clean: how many rows of each.

    A term stands in MIN_SHARE of the toxic rows at least, so the driver gets 1 / MIN_SHARE times as many as a toxic training text has
    terms on average, at most; training rows are a bounded sample.
    """
    counts = _share_counts(training, terms_of)
    p, q = (F.col("t") + 0.5) / (toxic + 1), (F.col("c") + 0.5) / (clean + 1)
    weight = F.log(p / (1 - p)) - F.log(q / (1 - q))
    z = weight / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = counts.filter((F.col("t") >= max(3, MIN_SHARE * toxic)) & (p > MIN_RATIO * q) & (z > MIN_Z)).select("term", weight.alias("w"), z.alias("z"))
    return {r.term: float(r.w) for r in sorted(kept.collect(), key=lambda r: (-r.z, r.term))}


def learned_exceptions(training: DataFrame, weights: dict[str, float], toxic: int, clean: int) -> tuple[str, ...]:
    """Pairs of neighbouring words, one of them a term, that are in a significantly larger share of clean texts.

    A pair stands in five clean training rows at least, which are a bounded sample, so the driver gets at most a fifth of their pairs with a term.
    """
    stems = {t[:-1] for t in weights if t.endswith("*")}

    def pairs(words: list[str]) -> set[str]:
        is_term = [w in weights or any(w[:n] in stems for n in STEMS) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], is_term, is_term[1:], strict=False) if x or y}

    counts = _share_counts(training, pairs)
    p, q = (F.col("t") + 0.5) / (toxic + 1), (F.col("c") + 0.5) / (clean + 1)
    z = (F.log(q / (1 - q)) - F.log(p / (1 - p))) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = counts.filter((F.col("c") >= 5) & (q > MIN_RATIO * p) & (z > EXCEPTION_Z)).select("term", z.alias("z"))
    return tuple(r.term for r in sorted(kept.collect(), key=lambda r: (-r.z, r.term)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and loss of a one-feature logistic fit, by Newton steps with a slight ridge."""
    a = b = 0.0
    loss = math.inf
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean() + 1e-4 * a * a)
        g = np.array([((p - y) * x).mean() + 2e-4 * a, (p - y).mean() + 2e-6 * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).mean() + 2e-4, (s * x).mean()], [(s * x).mean(), s.mean() + 2e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return a, b, loss


class Model:
    """Weights of terms, exception phrases, and the fitted power and curve; what matches them is built once in each worker."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = (), power: float = 0.0, slope: float = 0.0, offset: float = 0.0):
        self.weights, self.exceptions, self.power, self.slope, self.offset = weights, tuple(exceptions), power, slope, offset

    @cached_property
    def total(self) -> Callable[[list[str]], float]:
        return matcher(self.weights, self.exceptions)

    def logit(self, words: list[str]) -> float:
        return self.total(words) / max(len(words), 1) ** self.power * self.slope + self.offset


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """``(toxic, total, words)`` of ``(text, toxic)`` rows: the sum of weights and the number of words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # as many terms as lexicon and learned_exceptions say

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [fold(text) for text in batch.column(0).to_pylist()]
            sums = [float(shared.value.total(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, type=pa.float64()), pa.array(map(len, words), type=pa.int64())], names=["toxic", "total", "words"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, total double, words long")


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, exceptions: Sequence[str] = (), folds: int = FOLDS, fold_: int = HELD_OUT) -> Model:
    """A model learned from at most train_rows labelled rows outside the fold. exceptions: phrases beside those that are learned."""
    spark = documents.sparkSession
    marks = labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", folds, fold_))
    once = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = first_rows(once, [F.xxhash64("doc_id"), "doc_id"], F.shiftright(F.xxhash64("doc_id"), 48), train_rows)
    few = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.toxic > 0)) for r in chosen.collect()], "id long, toxic int"))  # train_rows rows
    texts = documents.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    training = written(texts.join(few, "id").select("text", "toxic"), "toxicity-training")
    toxic, n = training.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    weights = lexicon(training, toxic, n - toxic) if 0 < toxic < n else {}
    if not weights:
        share = (toxic + 1) / (n + 2)
        return Model({}, exceptions, offset=math.log(share / (1 - share)))
    model = Model(weights, (*exceptions, *learned_exceptions(training, weights, toxic, n - toxic)))
    rows = _features(training, model).toArrow()  # a row per training row
    total, words, y = (rows[c].to_numpy().astype(np.float64) for c in ("total", "words", "toxic"))
    best = min((_logistic(total / np.maximum(words, 1) ** power, y)[::-1] + (power,) for power in (0.0, 0.125, 0.25, 0.5, 0.75, 1.0)), key=lambda x: x[0])
    return Model(model.weights, model.exceptions, best[3], best[2], best[1])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as many terms as lexicon and learned_exceptions say

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.array([shared.value.logit(fold(text)) for text in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))], names=["doc_id", "score"])

    return documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    scored = score(documents, fit(documents, labels, **how))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that are not predicted to be toxic, all columns."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, id_col, text_col))  # as many terms as lexicon and learned_exceptions say
    schema = documents.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.logit(fold(text)) < 0 for text in batch.column(at).to_pylist()], type=pa.bool_()))

    return documents.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
