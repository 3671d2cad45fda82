"""What the training-data operators share: tables, the shared folder, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.rounds import remove_written, run_dir, settled  # noqa: F401

#: Rows in one Arrow batch. A batch holds whole texts, so it is kept small: the size of
#: a batch, not of a partition, bounds the memory of a Python worker.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; also bounds the rows of an Arrow batch.

    A table of fewer row groups than cores is dealt out to all of them; filters and columns still reach its scan.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the run's folder and read it again, as ``settled`` does; name: how its folder begins."""
    return settled(df, name)


def column(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of an operator's own columns cannot clash with them."""
    return F.struct(*map(column, df.columns))


def row_hash(df: DataFrame) -> Column:
    """A hash of the columns of plain types; rows that are alike in those have the same."""
    plain = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def row_keys(id_: Column, text_hash: Column) -> list[Column]:
    """Keys of a row that hold no null, so that a join and an aggregation after it share one shuffle."""
    return [F.coalesce(id_.cast("long").cast("string"), F.lit("")).alias("id"), F.coalesce(text_hash, F.lit(0).cast("long")).alias("hash")]


def keep_rows(documents: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of documents, all columns, for each ``(doc_id, text_hash)`` of keep.

    Of rows with the same doc_id and text that of the least ``row_hash`` stays.
    """
    keyed = documents.select(whole_row(documents).alias("row"), row_hash(documents).alias("tie"), *row_keys(column(id_col), F.xxhash64(column(text_col))))
    kept = keyed.join(keep.select(*row_keys(F.col("doc_id"), F.col("text_hash"))), ["id", "hash"], "left_semi")
    return kept.groupBy("id", "hash").agg(F.min_by("row", "tie").alias("row")).select("row.*")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(df: DataFrame) -> int:
    """Partitions for an explicit repartition: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first_rows(df: DataFrame, order: list, bucket: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows in an order, without a top list from every task.

    bucket: a whole number that rises with the order, of a bounded number of values. Buckets are
    counted, and only rows up to the one that reaches the limit are sorted. df is read twice.
    """
    total, last = 0, None
    for row in sorted(df.groupBy(bucket.alias("b")).count().collect()):
        total, last = total + row["count"], row["b"]
        if total >= limit:
            break
    return df.filter(bucket <= F.lit(last)).orderBy(*order).limit(limit) if total else df.limit(0)
