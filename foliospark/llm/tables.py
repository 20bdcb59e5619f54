"""Tables written between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    What follows starts from files every executor can reach, so a lost executor costs only
    its own tasks, and nothing random or expensive is computed a second time.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: bytes of an Arrow batch, which Spark and the Python worker hold several times over
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, whatever the size of a row; a limit set by the user stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):  # Spark's own default
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(taken, *names: str) -> list[str]:
    """``names``, lengthened until none is a column in ``taken``; Spark does not tell case apart."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list:
    """All columns by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
