"""Ranked search: boolean full text, BM25, reciprocal rank fusion and their mixture.

Terms are what is left of lower-case texts when split at white space. A query reads the texts once and
settles how often its terms stand in each document, and how long that is; scores, document frequencies
and lengths come from those rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.rounds import settled

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K = 60
#: Words that a full-text query leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def counted(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """``(id, size, tf)`` of every document: its words, and how often each of the terms stands in it; settled.

    Each word stands between two blanks of its own, so that a term is counted by what its removal takes away.
    """
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), _SPACE, "  ")
    spaced = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.btrim(words), F.lit(" ")).alias("s"))
    size = F.when(F.length("s") == 2, 0).otherwise((F.length("s") - F.length(F.replace(F.col("s"), F.lit(" "), F.lit("")))) / 2).cast("long")
    tf = [((F.length("s") - F.length(F.replace(F.col("s"), F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).cast("double") for t in terms]
    return settled(spaced.select("id", size.alias("size"), F.array(*tf).cast("array<double>").alias("tf")))


def mean_idf(docs: DataFrame, text_col: str, n: int) -> float:
    """The mean over all terms of the corpus; one aggregation of distinct terms, for queries with a term in over half of the documents."""
    per_term = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("df"))
    return per_term.agg(F.avg(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0]


def _bm25(rows: DataFrame, at: Sequence[int], mean: Callable[[int], float]) -> DataFrame:
    n, length, *df = rows.agg(F.count("*"), F.avg("size"), *[F.count_if(F.get("tf", F.lit(i)) > 0) for i in at]).first()
    if not n or not length:
        return rows.select("id", F.lit(0.0).alias("score"))
    raw = [math.log((n - d + 0.5) / (d + 0.5)) for d in df]
    low = FLOOR * mean(n) if any(x < 0 and d for x, d in zip(raw, df, strict=True)) else 0.0
    score = F.lit(0.0)
    for i, d, x in zip(at, df, raw, strict=True):
        if d:
            tf = F.get("tf", F.lit(i))
            score = score + (low if x < 0 else x) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / length))
    return rows.select("id", F.round(100 * score, 6).alias("score"))


def _full_text(rows: DataFrame, at: Sequence[int]) -> DataFrame:
    if not at:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    tf = [F.get("tf", F.lit(i)) for i in at]
    return rows.filter(reduce(and_, [x > 0 for x in tf])).select("id", F.round(100 * sum(x / (x + 1) for x in tf) / len(tf), 6).alias("score"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, mean: float | None = None) -> DataFrame:
    """``(id, score)`` of every document, also those with score 0; Okapi, times 100.

    A negative idf is replaced by FLOOR times the mean idf over all terms of the corpus; mean: that number, if it is known.
    """
    terms = terms_of(query)
    return _bm25(counted(docs, id_col, text_col, terms), range(len(terms)), lambda n: mean_idf(docs, text_col, n) if mean is None else mean)


def full_text(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """``(id, score)`` of documents with every term but stop words; an empty query finds nothing.

    The score is our own: the mean over terms of tf / (tf + 1), times 100.
    """
    terms = [t for t in terms_of(query) if t not in STOP_WORDS]
    return _full_text(counted(docs, id_col, text_col, terms), range(len(terms)))


def by_name(docs: DataFrame, id_col: str, name: Column, query: str, limit: int) -> DataFrame:
    """Names that contain the query, in order of name, with the constant score 50."""
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name")).filter(F.col("name").ilike(f"%{query}%"))
    return rows.orderBy("name", "id").limit(limit).select("id", F.lit(50.0).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def fuse(lists: Sequence[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists: ``(id, score, raw)``, raw the sum of 1 / (60 + rank), rank from 1; score that times 100, to two digits."""
    w = Window.orderBy(F.desc("score"), "id")  # lists are top-k results, cut before
    parts = [x.withColumn("r", 1.0 / (RRF_K + F.row_number().over(w))).select("id", "r") for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("id").agg(F.sum("r").alias("raw")).orderBy(F.desc("raw"), "id").limit(limit)
    return fused.select("id", F.round(100 * F.col("raw"), 2).alias("score"), "raw")


def filled(fused: DataFrame, limit: int, more: Callable[[], DataFrame]) -> DataFrame:
    """The first ``limit`` of a fusion; where it has less than half of them, others are sorted in by their scores."""
    if fused.count() >= limit // 2:
        return fused.orderBy(F.desc("raw"), "id").limit(limit).select("id", "score")
    both = fill(fused, more().withColumn("raw", F.lit(0.0)))
    return both.orderBy(F.desc("score"), F.desc("raw"), "id").limit(limit).select("id", "score")


def hybrid(docs: DataFrame, id_col: str, text_col: str, name: Column, query: str, limit: int, mean: float | None = None, others: DataFrame | None = None) -> DataFrame:
    """Full text and BM25 fused; if fewer than half the limit are found, names fill up and are sorted in. The texts are read once.

    others: a table with the id column where names are searched, if it isn't docs.
    """
    terms = terms_of(query)
    rows = counted(docs, id_col, text_col, terms)
    found = _full_text(rows, [i for i, t in enumerate(terms) if t not in STOP_WORDS])
    scored = _bm25(rows, range(len(terms)), lambda n: mean_idf(docs, text_col, n) if mean is None else mean)
    fused = settled(fuse([top(found, 3 * limit), top(scored, 3 * limit)], 2 * limit))  # 2 * limit rows
    return filled(fused, limit, lambda: by_name(docs if others is None else others, id_col, name, query, limit))


def fill(found: DataFrame, more: DataFrame) -> DataFrame:
    """Found and what of more isn't among it."""
    return found.unionByName(more.join(found.select("id"), "id", "left_anti"))


def pick(docs: DataFrame, scored: DataFrame, id_col: str, name_col: str, query: str) -> DataFrame:
    """The exact name among the top five, or else the first hit."""
    five = top(scored, 5).join(docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")), "id")
    return five.orderBy(F.when(F.col("name") == query, 0).otherwise(1), F.desc("score"), "id").limit(1)


def source_lines(nodes: DataFrame, files: DataFrame, before: int = 2) -> DataFrame:
    """``(id, first, lines)`` of nodes (id, file, start, stop) whose file (file, text) is there: its lines from ``before`` above start to stop."""
    text = F.split("text", "\n")
    first = F.greatest(F.col("start") - before, F.lit(1)).cast("int")
    last = F.least(F.col("stop"), F.size(text)).cast("int")
    return nodes.join(files, "file").select("id", first.alias("first"), F.slice(text, first, F.greatest(last - first + 1, F.lit(0))).alias("lines"))
