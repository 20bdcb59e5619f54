"""Collections laid out by id, so that updates read and write only what they touch.

A laid-out collection is a Parquet table partitioned by a hash of ``_id`` and bucketed by
``_id`` inside each partition.  Joins on ``_id`` use the buckets as they lie, so the stored side
is never shuffled; an update reads the partitions its ids fall into and replaces those as a
whole when it commits, other files stay as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified
from . import files

PARTS, BUCKETS = 64, 32
PART = "_part"
COLUMNS = ("_id", "_rev", "doc")


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int")


def table_of(spark: SparkSession, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> str:
    """The session's name for the table at ``path``, which is made known if it is not yet."""
    place = qualified(spark, path)
    name = "laid_out_" + hashlib.md5(f"{place}|{parts}|{buckets}".encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` string" for c in COLUMNS)
        spark.sql(
            f"create table {name} ({columns}, `{PART}` int) using parquet partitioned by (`{PART}`) "
            f"clustered by (`_id`) sorted by (`_id`) into {buckets} buckets location '{place}' "
            f"tblproperties ('parts' = '{parts}')"
        )
        if files.exists(spark, path):
            spark.sql(f"alter table {name} recover partitions")
    return name


def lay_out(df: DataFrame, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> str:
    """Write documents (``_id, _rev, doc``) as a laid-out collection; its table's name."""
    name = table_of(df.sparkSession, path, parts, buckets)
    _put(df, name, parts, buckets)
    return name


def _put(df: DataFrame, name: str, parts: int, buckets: int) -> None:
    """Replace the partitions that ``df`` has rows of; one file per partition and bucket."""
    rows = df.select(*COLUMNS, part_of(parts).alias(PART)).repartition(buckets, "_id")
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.sources.partitionOverwriteMode")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        conf.set("spark.sql.sources.partitionOverwriteMode", before)


def laid_out(spark: SparkSession, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> DataFrame:
    """A laid-out collection, dealt by ``_id`` as it lies."""
    return spark.table(table_of(spark, path, parts, buckets))


def touched(spark: SparkSession, path: str, updates: DataFrame, parts: int = PARTS, buckets: int = BUCKETS) -> DataFrame:
    """The stored rows in the partitions that the ids of ``updates`` fall into; at most ``parts`` numbers are collected."""
    hit = updates.where(F.col("_id").isNotNull()).select(part_of(parts).alias(PART)).distinct()
    numbers = [r[0] for r in hit.collect()]
    return laid_out(spark, path, parts, buckets).where(F.col(PART).isin(numbers) if numbers else F.lit(False))


def update_laid_out(spark: SparkSession, path: str, updates: DataFrame, apply, parts: int = PARTS, buckets: int = BUCKETS) -> int:
    """Change a laid-out collection in place; how many of its partitions were written.

    ``apply(stored) -> new state`` gets the touched partitions (``_id, _rev, doc``) and gives back
    all their rows, new ones included; ids of rows it adds have to be ids of ``updates``.  A run
    that dies has changed nothing, as partitions are replaced when the job commits.
    """
    stored = touched(spark, path, updates, parts, buckets)
    numbers = stored.select(PART).distinct().count()
    # the new state is written before what it was read from is replaced
    state = files.saved(apply(stored.drop(PART)).select(*COLUMNS), "touched")
    _put(state, table_of(spark, path, parts, buckets), parts, buckets)
    return numbers


def insert_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored rows and those incoming ones whose id is not taken; of equal ids the least document.

    For ``update_laid_out``: only the partitions of the new ids are looked at.
    """
    first = incoming.groupBy("_id").agg(F.min_by(F.struct("_rev", "doc"), "doc").alias("f")).select("_id", "f.*")
    fresh = first.join(stored.select("_id"), "_id", "left_anti")
    return stored.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))
