"""Operator 13, vector code compression: product quantisation in whole numbers.

Components become integers (floor of 4096 times the value) and vectors are cut into parts. Each
part has a codebook, learned by Lloyd's rounds with floored means, and a vector's code is the
number of the nearest entry for each part.

Vectors are held as columnar NumPy blocks, written once to the shared folder: for each part and
each dimension in it the values of up to ``BLOCK_ROWS`` vectors. A round is one treeAggregate over
the RDD of blocks: a block's distances to all entries accumulate dimension by dimension, and
``np.add.at`` adds its rows to int64 tensors of sums and counts, which merge through a reduction
tree. The driver gets one tensor a round, parts x entries x dimensions large, and sends back the
codebooks; vectors never leave their tasks. Blocks hold rows in order of reading, so neither a
repeated vector nor a hot label loads a task.

Integer sums give the same codebooks in any order of tasks. Where 64 bits might overflow for the
largest component and the number of rows, all arithmetic is in Python's whole numbers instead
(NumPy objects), so results stay exact; an error above the largest long is given as that.

Rows with a null vector, or one that holds null or non-finite components, are dropped. So are
vectors of another length than most have (ties: the longest), for no code book fits them. A length
that the number of parts doesn't divide is filled up with zeros. Codebooks start from the rows with
the least ids, null ids last, equal ids by components; with fewer rows than entries there
are as many entries as rows. Repeated rows stay and count each. An empty table, or one without a
vector to keep, gives no rows. Other columns are not read, whatever their names; ids, labels and
components may have any plain types, components numeric ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tessera.llm._shared import column, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Depth of the reduction tree.
DEPTH = 2
#: Distinct labels up to which their errors are broadcast.
BROADCAST_LABELS = 500_000
LONGEST = (1 << 63) - 1


def _kept(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows whose vector is whole, of the length that most have."""
    rows = embeddings.select(column(id_col).alias("id"), column(label_col).alias("label"), column(vector_col).cast("array<double>").alias("vector"))
    whole = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    lengths = whole.groupBy(F.size("vector").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("most")).first().most
    return whole.filter(F.size("vector") == F.lit(lengths.d if lengths else 0))


def whole_numbers(vectors: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x) of doubles; exact: as Python's whole numbers."""
    down = np.floor(vectors * float(scale))
    return np.array([int(x) for x in down.ravel()], dtype=object).reshape(down.shape) if exact else down.astype(np.int64)


def columnar(numbers: np.ndarray, parts: int) -> np.ndarray:
    """Rows x dimensions as parts x dimensions of a part x rows."""
    rows, dims = numbers.shape
    width = -(-dims // parts)
    filled = np.zeros((rows, parts * width), dtype=numbers.dtype)
    filled[:, :dims] = numbers
    return np.ascontiguousarray(filled.reshape(rows, parts, width).transpose(1, 2, 0))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, parts x rows each; ties go to the lower entry."""
    codes, errors = [], []
    for part, book in zip(block, books, strict=True):
        distance = np.zeros((len(book), block.shape[2]), dtype=books.dtype)
        for values, entries in zip(part, book.T, strict=True):
            apart = values[None, :].astype(books.dtype) - entries[:, None]
            distance += apart * apart
        best = distance.argmin(axis=0)
        codes.append(best)
        errors.append(distance[best, np.arange(block.shape[2])])
    return np.stack(codes), np.stack(errors)


def add_block(total: tuple | None, block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x dimensions) and counts (parts x entries) with the rows of a block added."""
    sums, counts = total or (np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64))
    codes, _ = nearest(block, books)
    for p, (part, code) in enumerate(zip(block, codes, strict=True)):
        np.add.at(sums[p], code, part.T.astype(books.dtype))
        np.add.at(counts[p], code, 1)
    return sums, counts


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def moved(books: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each entry as the floored mean of its rows; unused ones stay."""
    sums, counts = total
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _blocks(kept: DataFrame, parts: int, scale: int, block_rows: int, exact: bool, kind: str) -> DataFrame:
    """``(ids, labels, data)``: up to block_rows vectors in a row; data: their columns as bytes, or as decimal text where exact."""
    fields = kept.schema
    schema = f"ids array<{fields['id'].dataType.simpleString()}>, labels array<{fields['label'].dataType.simpleString()}>, width int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            vectors = rows.column("vector").combine_chunks()
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            numbers = columnar(whole_numbers(values, scale, exact), parts)
            data = " ".join(map(str, numbers.ravel())).encode() if exact else numbers.astype(kind).tobytes()
            columns = [pa.array([rows.column(c).to_pylist()], type=pa.list_(rows.schema.field(c).type)) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([numbers.shape[1]], type=pa.int32()), pa.array([data], type=pa.binary())], names=["ids", "labels", "width", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                if sum(b.num_rows for b in held) + part.num_rows > block_rows:
                    yield block()
                    held = []
                held.append(part)
        if sum(b.num_rows for b in held):
            yield block()

    return written(kept.mapInArrow(run, schema), "vector-blocks")


def _opened(data: bytes, width: int, parts: int, exact: bool, kind: str) -> np.ndarray:
    flat = np.array([int(x) for x in data.split()], dtype=object) if exact else np.frombuffer(bytes(data), dtype=kind)
    return flat.reshape(parts, width, -1) if width else flat.reshape(parts, 0, 0)


class Quantiser:
    """Learned codebooks over settled blocks of vectors; ``books``: parts x entries x dimensions."""

    def __init__(self, embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS):
        self.spark, self.parts = embeddings.sparkSession, parts
        kept = _kept(embeddings, id_col, vector_col, label_col)
        largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
        n, most, dims = kept.agg(F.count("*"), F.max(largest), F.max(F.size("vector"))).first()
        self.rows, self.empty = n, not n or not dims
        bound = int(np.ceil((most or 0.0) * float(scale))) + 1
        # distances of all dimensions, and sums of all rows, must stay below 2^63
        self.exact = max(4 * bound * bound * max(dims or 0, 1), bound * max(n, 1)) >= 1 << 63
        self.kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63), ("O", 0)) if bound < top or k == "O")
        self.blocks = _blocks(kept, parts, scale, block_rows, self.exact, self.kind)
        if self.empty:
            self.books = np.zeros((parts, 0, 0), dtype=np.int64)
            return
        first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # as many rows as entries
        start = whole_numbers(np.array([r.vector for r in first], dtype=np.float64), scale, self.exact)
        self.books = columnar(start, parts).transpose(0, 2, 1)
        for _ in range(rounds):
            self.books = moved(self.books, self._totals())

    def _totals(self) -> tuple[np.ndarray, np.ndarray]:
        parts, exact, kind = self.parts, self.exact, self.kind
        shared = self.spark.sparkContext.broadcast(self.books)  # parts x entries x dimensions

        def add(total: tuple | None, row: Row) -> tuple:
            return add_block(total, _opened(row.data, row.width, parts, exact, kind), shared.value)

        found = self.blocks.select("width", "data").rdd.treeAggregate(None, add, merged, depth=DEPTH)
        shared.unpersist()
        return found

    def sha256(self) -> str:
        """Of all entries' components as decimal text, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """``(id, label, code, error)`` of every kept vector."""
        parts, exact, kind = self.parts, self.exact, self.kind
        shared = self.spark.sparkContext.broadcast(self.books)  # parts x entries x dimensions
        id_type, label_type = (self.blocks.schema[c].dataType.elementType for c in ("ids", "labels"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, width, data in zip(*batch.columns, strict=True):
                    codes, errors = nearest(_opened(data.as_py(), width.as_py(), parts, exact, kind), shared.value)
                    texts = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
                    total = [min(int(e), LONGEST) for e in errors.sum(axis=0)]
                    yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(texts), pa.array(total, type=pa.int64())], names=["id", "label", "code", "error"])

        schema = f"id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long"
        return self.blocks.select("ids", "labels", "width", "data").mapInArrow(run, schema) if not self.empty else self.spark.createDataFrame([], schema)


def compress(embeddings: DataFrame, **options) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``; label_error: the error summed over equal labels, nulls together, at most the largest long."""
    learned = Quantiser(embeddings, **options)
    found = written(learned.codes(), "vector-codes")
    total: Column = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long")
    labels = written(found.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "vector-labels")
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    joined = found.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(learned.sha256()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds as one statement, a pair of tables for each."""
    assign = """SELECT vec_id, label, p, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.label, x.p, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN {book} b USING (p)) GROUP BY vec_id, label, p, v"""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, v AS c FROM parts QUALIFY entry < {entries})",
    ]
    for i in range(rounds):
        steps.append(f"near{i} AS MATERIALIZED ({assign.format(book=f'book{i}')})")
        steps.append(f"""mean{i} AS (SELECT p, entry, list(m ORDER BY k) AS c FROM (SELECT p, entry, k, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT p, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM near{i}) GROUP BY p, entry, k) GROUP BY p, entry)""")
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.entry = b.entry)")
    last = f"book{rounds}"
    steps.append(f"final AS ({assign.format(book=last)})")
    steps.append("coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id)")
    steps.append(f"text AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM {last})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, text"


SQL = _sql()
