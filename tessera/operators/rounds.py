"""The folder that driver and executors share, and tables settled there: between the rounds of a loop, and for several readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this run below the shared one.
RUN = f"tessera-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only a local session may leave it unset; it then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this run: all that operators write there on their way. ``remove_written`` removes it."""
    return f"{folder(spark)}/{RUN}"


def remove_written(spark: SparkSession) -> None:
    """Remove what operators wrote on their way; call it when no result of theirs will be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to the run's folder as Parquet and read from there.

    This cuts the lineage: rounds neither repeat nor nest their plans, a later job rereads files that
    outlive any executor, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
