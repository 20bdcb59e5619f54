"""Partition-restricted reads and predefined filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.selector import where


def write_partitioned(df: DataFrame, column: str, path: str) -> str:
    """Lay a collection out by partition value, so that reads can skip the rest.

    The rows are spread over the writers as they are: a partition value holding
    a large share of the rows is written by many tasks, not gathered into one.
    """
    df.write.partitionBy(column).parquet(path)
    return path


def in_partition(spark: SparkSession, path: str, column: str, value, schema=None) -> DataFrame:
    """The rows of one named partition of a collection laid out by :func:`write_partitioned`."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return where(reader.parquet(path), {column: value})


def create_partial_view(df: DataFrame, selector: dict, name: str) -> DataFrame:
    """A reusable view with ``selector`` already applied; user selectors go on top."""
    where(df, selector).createOrReplaceTempView(name)
    return df.sparkSession.table(name)
