"""File-system facts the planner needs before a read is declared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob pattern names anything."""
    p, fs = _path(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet file, or a folder with at least one, is there."""
    if not is_folder(spark, path):
        return path.endswith(".parquet") and exists(spark, path)
    return matches(spark, path.rstrip("/") + "/*.parquet")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where there is no folder."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all, and replaces none."""
    p, fs = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read from there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
