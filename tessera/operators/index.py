"""A search index on disk: built once from texts, asked many times, grown by segments.

A segment holds three Parquet folders. ``postings``: a row for each term and block of documents
(documents of one type that were read together, at most ``WIDTH`` of them), with the ids, counts
and lengths of the documents of that block that hold the term, and above them the largest count and the
least length, which bound the score of every document of the block. ``terms``: how many documents of each
type hold a term. ``documents``: id, type and length of each. Postings and terms lie in folders by the
CRC of the term, sorted by term, so that a query opens only its terms' folders and row groups.

``statistics`` has a version for each build and append: which segments count, and for every type and
for all of them the documents, their length and the mean idf of all terms. It is written last, so a reader
sees a whole version or the one before.

Building counts words and makes the lists of postings where texts are read, and shuffles the lists once, by folder and to
several tasks a folder; a term that stands in every document is a row a block, dealt to one folder among ``SHARDS``. A query sums the bounds of a block
over its terms, takes the k-th best score of the most promising blocks, and scores only those blocks that
may hold a better one.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.rounds import settled
from tessera.operators.search import B, FLOOR, K1, STOP_WORDS, by_name, filled, fuse, terms_of, tokens, top

#: Documents of a block at most, as a power of two.
WIDTH = 256
#: Folders of postings.
SHARDS = 32
#: Rows in one Arrow batch; a batch holds whole texts, so it bounds the memory of a Python worker.
ARROW_ROWS = 512
#: Tasks that a share of the texts, as many as one task reads, is dealt to as postings at least.
SHARES = 4
#: Blocks of a query's terms up to which all are scored at once, without bounds.
UNPRUNED = 2_000
#: The row of all types among those of each; types themselves have a sign before them.
_ALL = "*"


@dataclass(frozen=True)
class Index:
    """What a version of an index says of itself: segments, folders, and by type ``(documents, mean length, mean idf)``."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...]
    shards: int
    kinds: dict[str, tuple[int, float, float]]

    def part(self, name: str) -> DataFrame:
        """The rows of ``postings``, ``terms`` or ``documents`` of all segments, with the segment's number."""
        return _read(self.spark, self.path, name, self.segments)


def _kind(kind: str | None) -> str:
    return _ALL if kind is None else f"={kind}"


def _shard(term: str, shards: int) -> int:
    return zlib.crc32(term.encode()) % shards


def _read(spark: SparkSession, path: str, name: str, segments: Sequence[str]) -> DataFrame:
    """Rows of all segments; with a schema of their own, for a segment without terms has no file to take one from."""
    parts = []
    for i, s in enumerate(segments):
        documents = spark.read.parquet(f"{path}/{s}/documents")
        own = documents.schema["id"].dataType.simpleString()
        schema = {"postings": f"term string, kind string, block long, n int, most int, shortest int, docs array<struct<id:{own},tf:int,size:int>>, shard int", "terms": "term string, kind string, df long, shard int"}
        parts.append((documents if name == "documents" else spark.read.schema(schema[name]).parquet(f"{path}/{s}/{name}")).withColumn("segment", F.lit(i)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


def _lists(rows: DataFrame, width: int) -> DataFrame:
    """``(term, kind, block, n, most, shortest, ids, tfs, sizes)`` of rows ``(id, kind, words)``: the postings of each term and block.

    A block is what one task reads together of a type, up to width rows, so words are counted and listed where
    they are read, and lists are all that is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, len(whole), width):
                batch = whole.slice(at, width)
                kinds, words = batch.column(1).dictionary_encode(), batch.column(2)
                sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = words.flatten().dictionary_encode()
                if not len(terms):
                    continue
                doc = np.repeat(np.arange(len(batch)), sizes)
                kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # one number for a type, a term and a row, so that equal ones stand together when sorted
                lists = kind[doc] * len(terms.dictionary) + terms.indices.to_numpy(zero_copy_only=False)
                found, tf = np.unique(lists * len(batch) + doc, return_counts=True)
                own, doc = np.divmod(found, len(batch))
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                kind, term = np.divmod(own[start], len(terms.dictionary))
                ends = pa.array(np.r_[start, len(own)].astype(np.int32))
                size = sizes[doc].astype(np.int32)
                tf = tf.astype(np.int32)
                made = [
                    terms.dictionary.take(pa.array(term)),
                    kinds.dictionary.take(pa.array(kind)),
                    pa.array(np.full(len(start), block, np.int64)),
                    pa.array(np.diff(np.r_[start, len(own)]).astype(np.int32)),
                    pa.array(np.maximum.reduceat(tf, start)),
                    pa.array(np.minimum.reduceat(size, start)),
                    *(pa.ListArray.from_arrays(ends, values) for values in (batch.column(0).take(pa.array(doc)), pa.array(tf), pa.array(size))),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["term", "kind", "block", "n", "most", "shortest", "ids", "tfs", "sizes"])
                block += 1

    own = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, kind string, block long, n int, most int, shortest int, ids array<{own}>, tfs array<int>, sizes array<int>")


def _dealt(df: DataFrame, shards: int, tasks: int) -> DataFrame:
    """Rows with a term by folder, and each folder by the term to several tasks, so that a task's share doesn't grow with the input."""
    parts = max(1, -(-tasks // shards))
    crc = F.crc32(F.col("term").cast("binary"))
    return df.withColumns({"shard": (crc % shards).cast("int"), "_part": F.pmod(F.floor(crc / shards), F.lit(parts)).cast("int")}).repartition(shards * parts, "shard", "_part")


def _write_segment(docs: DataFrame, path: str, id_col: str, text_col: str, type_col: str | None, shards: int, width: int) -> str:
    segment = f"segment-{uuid.uuid4().hex}"
    kind = F.concat(F.lit("="), F.coalesce(F.col(type_col).cast("string"), F.lit(""))) if type_col else F.lit("=")
    rows = docs.select(F.col(id_col).alias("id"), kind.alias("kind"), tokens(F.col(text_col)).alias("words"))
    spark, folder = docs.sparkSession, f"{path}/{segment}"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    splits = docs.rdd.getNumPartitions()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SHARES * splits)
    rows.select("id", "kind", F.size("words").alias("size")).write.parquet(f"{folder}/documents")
    lists = _dealt(_lists(rows, width), shards, tasks).sortWithinPartitions("shard", "term", "kind", "block")
    columns = [c for c in lists.columns if c not in ("ids", "tfs", "sizes", "_part", "shard")]
    docs_ = F.transform("ids", lambda d, i: F.struct(d.alias("id"), F.get("tfs", i).alias("tf"), F.get("sizes", i).alias("size")))
    lists.select(*columns, docs_.alias("docs"), "shard").write.partitionBy("shard").parquet(f"{folder}/postings")
    known = _dealt(_read(spark, path, "postings", [segment]).select("term", "kind", "n"), shards, tasks).groupBy("shard", "_part", "term", "kind").agg(F.sum("n").alias("df"))
    known.drop("_part").sortWithinPartitions("shard", "term", "kind").write.partitionBy("shard").parquet(f"{folder}/terms")
    return segment


def _write_statistics(spark: SparkSession, path: str, version: int, segments: Sequence[str], shards: int) -> None:
    sizes = _read(spark, path, "documents", segments).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    both = sizes.union(sizes.agg(F.lit(_ALL), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))))
    terms = _read(spark, path, "terms", segments).select("term", "kind", "df")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), terms.rdd.getNumPartitions())
    of = terms.repartition(tasks, "term").groupBy("term", "kind").agg(F.sum("df").alias("df"))  # both sums from one shuffle, by term
    each = of.union(of.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.lit(_ALL), "df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = each.join(F.broadcast(both.select("kind", "n")), "kind").groupBy("kind").agg(F.avg(idf).alias("mean_idf"))  # as many rows as types
    rows = both.join(mean, "kind", "left").select("kind", "n", "total", F.coalesce("mean_idf", F.lit(0.0)).alias("mean_idf"), F.array(*map(F.lit, segments)).alias("segments"), F.lit(shards).alias("shards"))
    rows.coalesce(1).write.parquet(f"{path}/statistics/version={version}")


def build(docs: DataFrame, path: str, id_col: str, text_col: str, type_col: str | None = None, shards: int = SHARDS, width: int = WIDTH) -> Index:
    """A new index of all texts in the folder ``path``. Types are texts; a null one is the empty type, a null text has no terms."""
    segment = _write_segment(docs, path, id_col, text_col, type_col, shards, width)
    _write_statistics(docs.sparkSession, path, 0, [segment], shards)
    return opened(docs.sparkSession, path)


def append(index: Index, docs: DataFrame, id_col: str, text_col: str, type_col: str | None = None, width: int = WIDTH) -> Index:
    """The index with documents whose ids it doesn't hold yet, as one more segment; what is there isn't written again."""
    segment = _write_segment(docs, index.path, id_col, text_col, type_col, index.shards, width)
    _write_statistics(index.spark, index.path, index.version + 1, [*index.segments, segment], index.shards)
    return opened(index.spark, index.path)


def opened(spark: SparkSession, path: str) -> Index:
    """The last version of the index in a folder."""
    rows = spark.read.parquet(f"{path}/statistics")
    last = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()  # a row a type
    kinds = {r.kind: (r.n, r.total / r.n if r.n else 0.0, r.mean_idf) for r in last}
    return Index(spark, path, last[0].version, tuple(last[0].segments), last[0].shards, kinds)


def _of_terms(index: Index, name: str, terms: Sequence[str], kind: str) -> DataFrame:
    rows = index.part(name).filter(F.col("shard").isin(*{_shard(t, index.shards) for t in terms}) & F.col("term").isin(*terms))
    return rows if kind == _ALL else rows.filter(F.col("kind") == kind)


def postings(index: Index, terms: Sequence[str], kind: str | None = None) -> DataFrame:
    """The blocks ``(term, kind, block, n, most, shortest, docs)`` of some terms; segments number their blocks alike, so ``block`` has the segment too."""
    return _of_terms(index, "postings", terms, _kind(kind)).withColumn("block", F.struct("segment", "kind", "block"))


def weights(index: Index, terms: Sequence[str], kind: str | None = None) -> dict[str, float]:
    """The idf of each term that stands in a document of the type; a negative one is FLOOR times the mean of all terms."""
    n, _, mean = index.kinds.get(_kind(kind), (0, 0.0, 0.0))
    df = {r.term: r.df for r in _of_terms(index, "terms", terms, _kind(kind)).groupBy("term").agg(F.sum("df").alias("df")).collect()} if terms and n else {}  # a row a term
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    return {t: FLOOR * mean if x < 0 else x for t, x in raw.items()}


def _gain(weight: Column, tf: Column, size: Column, length: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (length or 1.0)))


def _scored(blocks: DataFrame, length: float) -> DataFrame:
    each = blocks.select("weight", F.explode("docs").alias("d")).select("weight", "d.*")
    return each.groupBy("id").agg(F.sum(_gain(F.col("weight"), F.col("tf"), F.col("size"), length)).alias("score"))


def bm25(index: Index, query: str, k: int, kind: str | None = None, unpruned: int = UNPRUNED) -> DataFrame:
    """``(id, score)`` of the k best documents of a type, or of all; Okapi, times 100; documents without any term have score 0.

    Only blocks whose bound reaches the k-th score of the most promising ones are opened, unless there are
    fewer than ``unpruned`` blocks or an idf is negative.
    """
    of = weights(index, terms_of(query), kind)
    length = index.kinds.get(_kind(kind), (0, 0.0, 0.0))[1]
    documents = index.part("documents") if kind is None else index.part("documents").filter(F.col("kind") == _kind(kind))
    zero = documents.orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
    if not of:
        return zero
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(x)) for t, x in of.items()])
    blocks = postings(index, list(of), kind).withColumn("weight", weight)
    if min(of.values()) >= 0 and blocks.count() > unpruned:
        blocks = pruned(blocks, k, length)
    best = settled(top(_scored(blocks, length).select("id", F.round(100 * F.col("score"), 6).alias("score")), k))  # k rows
    if min(of.values()) >= 0 and best.count() == k and best.agg(F.min("score")).first()[0] > 0:
        return best
    every = _scored(postings(index, list(of), kind).withColumn("weight", weight), length).select("id", F.round(100 * F.col("score"), 6).alias("score"))
    rest = documents.join(every.select("id"), "id", "left_anti").orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
    return top(every.unionByName(rest), k)


def pruned(blocks: DataFrame, k: int, length: float) -> DataFrame:
    """The blocks that may hold one of the k best documents; weights mustn't be negative."""
    bound = _gain(F.col("weight"), F.col("most"), F.col("shortest"), length)
    bounds = settled(blocks.groupBy("block").agg(F.sum(bound).alias("bound"), F.max("n").alias("n")))  # a row a block of documents
    likely = bounds.orderBy(F.desc("bound"), "block").limit(k).select("block")  # of a document at least, so they hold k
    sample = blocks.join(F.broadcast(likely), "block", "left_semi")
    reached = _scored(sample, length).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    if reached[1] < k:
        return blocks
    # a bound and a score are sums in different orders: keep what is within rounding, and ties for the order by id
    return blocks.join(bounds.filter(F.col("bound") >= reached[0] * (1 - 1e-9) - 1e-8).select("block"), "block", "left_semi")


def full_text(index: Index, query: str, kind: str | None = None) -> DataFrame:
    """``(id, score)`` of the documents with every term but stop words, as ``search.full_text`` has them."""
    terms = [t for t in terms_of(query) if t not in STOP_WORDS]
    if not terms:
        return index.part("documents").select("id", F.lit(0.0).alias("score")).limit(0)
    each = postings(index, terms, kind).select("term", F.explode("docs").alias("d")).select("d.id", F.col("d.tf").cast("double").alias("tf"))
    found = each.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("tf") / (F.col("tf") + 1)).alias("s"))
    return found.filter(F.col("n") == len(terms)).select("id", F.round(100 * F.col("s") / len(terms), 6).alias("score"))


def hybrid(index: Index, names: DataFrame, id_col: str, name: Column, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """Full text and BM25 fused, names sorted in if fewer than half the limit are found; as ``search.hybrid``, from the index."""
    found, scored = top(full_text(index, query, kind), 3 * limit), bm25(index, query, 3 * limit, kind)
    fused = settled(fuse([found, scored], 2 * limit))  # 2 * limit rows
    return filled(fused, limit, lambda: by_name(names, id_col, name, query, limit))
