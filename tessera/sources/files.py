"""Files as tables: source trees, report folders, zip members, objects; and sinks."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folders (with wildcards) and endings that a source tree leaves out.
IGNORED_FOLDERS = (
    ".git", ".gitnexus", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", ".env", "node_modules", "bower_components", ".next", ".nuxt", "dist", "build", "target",
    ".idea", ".vscode", ".vs", ".tox", ".eggs", "*.egg-info", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".yarn", ".pnp.*", "coverage", ".coverage",
)
IGNORED_ENDINGS = (
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".exe", ".bin", ".obj", ".o", ".a", ".lib", ".class", ".jar", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot",
    ".mp3", ".mp4", ".avi", ".mov", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".min.js", ".min.css", ".map", ".log", ".lock",
)
MAX_BYTES = 1 << 20


def _glob(pattern: str) -> str:
    """A gitignore pattern as a regular expression on a relative path."""
    folder = pattern.rstrip("/")
    anchored = "/" in folder
    body = fnmatch.translate(folder.lstrip("/")).removesuffix("\\Z").removesuffix("\\z").removeprefix("(?s:").removesuffix(")")
    return ("^" if anchored else "(^|.*/)") + body + ("/.*" if pattern.endswith("/") else "(/.*)?") + "$"


def source_files(spark: SparkSession, root: str, ignore: Sequence[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, length, text)`` of a tree's files, by relative path: no ignored folders, endings or patterns, none too large.

    Names and sizes are filtered before any content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.regexp_replace("path", f"^.*?{root.removeprefix('file://').rstrip('/')}/", "")
    kept = files.filter(F.col("length") <= max_bytes).withColumn("_p", place)
    folders = "|".join(re.escape(f).replace(r"\*", "[^/]*") for f in IGNORED_FOLDERS)
    endings = "|".join(map(re.escape, IGNORED_ENDINGS))
    kept = kept.filter(~F.rlike("_p", F.lit(f"(^|/)({folders})/")) & ~F.rlike("_p", F.lit(f"(?i)({endings})$")))
    for pattern in ignore:
        if pattern and not pattern.startswith("#"):
            kept = kept.filter(~F.col("_p").rlike(_glob(pattern)))
    return kept.select(F.col("_p").alias("path"), "length", F.decode("content", "UTF-8").alias("text")).orderBy("path")


def report_files(spark: SparkSession, root: str, suffix: str = "report.json") -> DataFrame:
    """``(path, modified, json)`` of every report below a prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("json"))


def zip_members(spark: SparkSession, root: str, member: str = "widgets/summary.json") -> DataFrame:
    """``(path, text)`` of one member of every zip file below a prefix; null where it isn't there or the file is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(content: bytes) -> str | None:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    return z.read(member).decode()
            except (KeyError, zipfile.BadZipFile, UnicodeDecodeError):
                return None

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [text(c) for c in batch["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def last_json(text: str | None) -> str | None:
    """The last balanced JSON object of an output, found from its end; null if there is none."""
    end = (text or "").rfind("}")
    while end >= 0:
        start = text.rfind("{", 0, end)
        while start >= 0:
            try:
                json.loads(text[start : end + 1])
            except ValueError:
                start = text.rfind("{", 0, start) if start else -1
            else:
                while (outer := text.rfind("{", 0, start)) >= 0:
                    try:
                        json.loads(text[outer : end + 1])
                    except ValueError:
                        break
                    start = outer
                return text[start : end + 1]
        end = text.rfind("}", 0, end)
    return None


def trailing_json(logs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, json)`` of the last JSON object in each output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.iloc[:, 0], "json": batch.iloc[:, 1].map(last_json)})

    return logs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInPandas(run, "id string, json string")


def write_version(df: DataFrame, path: str, version: Sequence[str]) -> None:
    """Replace just the versions that df holds; a repeated write changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*version).parquet(path)


def write_texts(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_reports(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Reports as JSON lines below a folder for each key."""
    df.write.mode("append").partitionBy(*by).json(path)


def documents(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """JSON documents with a given schema, filtered as they are read."""
    read = spark.read.schema(schema).json(path)
    return read if where is None else read.filter(where)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON or YAML file, enabled ones, by falling priority. A rule file is small and is read by the driver through Spark."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        rows = json.loads(text)
    except ValueError:
        import yaml

        rows = yaml.safe_load(text)
    rows = rows.get("rules", []) if isinstance(rows, dict) else rows
    kept = [(r["id"], r["category"], int(r.get("priority", 0)), float(r.get("confidence", 0.5)), [str(c) for c in r.get("status_code") or []], list(r.get("error_message_patterns") or [])) for r in rows if r.get("enabled", True)]
    schema = "id string, category string, priority int, confidence double, status_code array<string>, patterns array<string>"
    return spark.createDataFrame(kept, schema).orderBy(F.desc("priority"), "id")


def rule_tuples(spark: SparkSession, path: str) -> list[tuple]:
    """Rules of a file in the form that ``diagnosis.classify`` takes."""
    return [(r.id, r.category, r.priority, r.confidence, tuple(int(c) for c in r.status_code), tuple(r.patterns)) for r in rules(spark, path).collect()]
