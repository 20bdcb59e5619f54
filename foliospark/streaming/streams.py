"""Incremental forms: intake of documents, iteration state, and upserts.

All three are native streaming plans.  Sinks write one folder per micro-batch
(``batch=<id>``) with overwrite, so a batch replayed after a failure replaces
itself instead of adding rows twice.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.rawjson import raw_entries
from ..operators.updates import merge_documents, usage_present
from ..sources import files


def _trigger(writer, interval: str | None):
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _list_in_few_tasks(spark: SparkSession) -> None:
    """List the files of a batch in as many tasks as run at once.

    Spark's own choice is a task for each file, which costs more than reading a small one.  The
    setting is the session's, as a stream looks at it in every batch, and is only ever lowered.
    """
    tasks = spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING)) > tasks:
        spark.conf.set(LISTING, tasks)


def read_json_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON files of a folder as a stream of documents, one per file."""
    _list_in_few_tasks(spark)
    raw = (
        spark.readStream.option("wholetext", "true")
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path, wholetext=True)
    )
    return raw.select(F.col("value").alias("doc"), F.try_parse_json("value").alias("v"))


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    _list_in_few_tasks(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def intake(docs: DataFrame, out: str, checkpoint: str, interval: str | None = None):
    """Append a stream of documents to a collection; exactly once by the file sink's log."""
    writer = docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _trigger(writer.outputMode("append"), interval).start()


#: folders taken in at the same time by ``intake_folders``
FOLDERS_AT_ONCE = 4


def intake_folders(spark: SparkSession, path: str, out: str, checkpoint: str, at_once: int = FOLDERS_AT_ONCE) -> None:
    """Take in the JSON files of every folder below ``path`` that are not taken in yet.

    A stream's driver holds the name of each file of its folder, new or not.  Here each folder has a stream,
    a checkpoint and a collection of its own, and a few run at once: the driver holds as much as those hold.
    """
    names = [n for n in sorted(files.children(spark, path)) if files.is_folder(spark, f"{path}/{n}")]
    for first in range(0, len(names), at_once):
        some = names[first : first + at_once]
        started = [intake(read_json_stream(spark, f"{path}/{n}").select("doc"), f"{out}/{n}", f"{checkpoint}/{n}") for n in some]
        try:
            for stream in started:
                stream.awaitTermination()
        finally:
            for stream in started:
                stream.stop()


def taken_in(spark: SparkSession, out: str) -> DataFrame:
    """The documents of all folders that ``intake_folders`` has taken in, each by its own sink's log."""
    none = spark.createDataFrame([], "doc string")
    return reduce(DataFrame.union, [spark.read.schema("doc string").parquet(f"{out}/{n}") for n in sorted(files.children(spark, out))] or [none])


def iteration_state(calls: DataFrame, key: str = "iteration_id", seq: str = "call") -> DataFrame:
    """Running metadata per iteration document as a streaming aggregate.

    Map-side combined, with a few numbers of state per document: a document with very
    many calls costs no more than another.  Messages stay rows in the sink.
    """
    has = usage_present(F.col("usage"))
    return calls.groupBy(key).agg(
        F.count("*").alias("iterations_completed"),
        F.sum(F.when(has, F.coalesce("usage.total_tokens", F.lit(0)))).alias("total_tokens"),
        F.max_by("usage", F.when(has, F.col(seq))).alias("last_token_count"),
        F.max(seq).alias("last_call"),
    )


STATE = "first_call long, iterations_completed long, total_tokens long, prompt long, completion long, total long, usage_call long, last_call long"


def ending_iterations(
    calls: DataFrame, length: int, key: str = "iteration_id", seq: str = "call", idle_seconds: float | None = None
) -> DataFrame:
    """``iteration_state`` whose state ends: at ``length`` calls, or after ``idle_seconds`` without one.

    Rows are ``key``, the STATE columns and ``ended``.  What ends is forgotten; calls that come after
    begin a new part, named by ``first_call`` (a call seen when it began), and ``ended_totals`` adds a
    document's parts up, so no call is lost or counted twice.  A document's calls have numbers of
    their own; those of a batch are read piece by piece.
    """
    names = [f.split()[0] for f in STATE.split(", ")]
    usage = [F.col(f"usage.{f}_tokens").alias(f) for f in ("prompt", "completion", "total")]
    flat = calls.select(key, F.col(seq).cast("long").alias("seq"), *usage)
    kind = flat.schema[key].dataType.simpleString()
    columns = pd.Index([key, *names, "ended"])

    def follow(group, frames, state):
        if state.hasTimedOut:
            known = state.get
            state.remove()
            yield pd.DataFrame([(*group, *known, True)], columns=columns)
            return
        first, done, tokens, p, c, t, at, last = state.get if state.exists else (None, 0, None, None, None, None, None, None)
        for frame in frames:
            # a few calls at a time: plain arrays cost a tenth of what frames do
            numbers, *used = (frame[f].to_numpy() for f in ("seq", "prompt", "completion", "total"))
            done += len(numbers)
            first = int(np.nanmin(numbers)) if first is None else first
            last = int(np.nanmax(numbers)) if last is None else max(last, int(np.nanmax(numbers)))
            given = np.flatnonzero(~np.all([pd.isna(u) for u in used], axis=0))
            if len(given):
                totals = used[2][given]
                tokens = (tokens or 0) + int(totals[~pd.isna(totals)].sum())
                newest = given[np.nanargmax(numbers[given])]
                if at is None or numbers[newest] > at:
                    at = int(numbers[newest])
                    p, c, t = (None if pd.isna(u[newest]) else int(u[newest]) for u in used)
        now = (first, done, tokens, p, c, t, at, last)
        if done >= length:
            state.remove()
        else:
            state.update(now)
            if idle_seconds is not None:
                state.setTimeoutDuration(int(idle_seconds * 1000))
        row = np.empty((1, len(columns)), object)
        row[0, :] = (*group, *now, done >= length)
        yield pd.DataFrame(row, columns=columns, copy=False)

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return flat.groupBy(key).applyInPandasWithState(follow, f"`{key}` {kind}, {STATE}, ended boolean", STATE, "update", timeout)


def ended_totals(rows: DataFrame, key: str = "iteration_id") -> DataFrame:
    """``iteration_state`` per document from the written batches of ``ending_iterations``."""
    parts = rows.groupBy(key, "first_call").agg(F.max_by(F.struct(*[f.split()[0] for f in STATE.split(", ")[1:]]), "batch").alias("s"))
    usage = F.struct(F.col("s.prompt").alias("prompt_tokens"), F.col("s.completion").alias("completion_tokens"), F.col("s.total").alias("total_tokens"))
    return parts.groupBy(key).agg(
        F.sum("s.iterations_completed").alias("iterations_completed"),
        F.sum("s.total_tokens").alias("total_tokens"),
        F.max_by(usage, F.col("s.usage_call")).alias("last_token_count"),
        F.max("s.last_call").alias("last_call"),
    )


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "update", interval: str | None = None):
    """Each micro-batch as its own folder, replaced when replayed."""

    def save(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, interval).start()


def batches(spark: SparkSession, out: str, folded: str | None = None) -> DataFrame:
    """Rows of the written batches; of those folded into ``folded`` the folded rows instead.

    Where ``compact`` has run, its newest snapshot and the batches behind it.
    """
    if folded is None:
        known = manifest(spark, out)
        if known is None:
            return spark.read.parquet(out)
        done = spark.read.parquet(known["snapshot"])
        later = [f"{out}/batch={n}" for n in batch_numbers_in(spark, out) if n > known["upto"]]
        if not later:
            return done
        return spark.read.option("basePath", out).parquet(*later).unionByName(done)
    rows = spark.read.parquet(out)
    done = spark.read.parquet(folded)
    upto = done.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") > upto).unionByName(done)


def batch_numbers_in(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches that are written whole."""
    names = [n for n in files.children(spark, out) if n.startswith("batch=")]
    return sorted(int(n[6:]) for n in names if files.exists(spark, f"{out}/{n}/_SUCCESS"))


def manifest(spark: SparkSession, out: str) -> dict | None:
    """The newest manifest of ``compact``: version, snapshot, upto and the batches retired before it."""
    versions = [n for n in files.children(spark, f"{out}-folded") if n.endswith(".json")]
    return json.loads(files.read_text(spark, f"{out}-folded/{max(versions)}")) if versions else None


def compact(spark: SparkSession, out: str, fold) -> dict | None:
    """Fold what is written into one snapshot and retire the batches folded the time before.

    ``fold(rows) -> rows`` is the folding, such as ``newest_rows`` or ``last_fields``.  A snapshot counts
    from the moment its manifest appears, which happens in one step; readers see the old state
    or the new one, and a run that dies before leaves files no one names.  Batches live on
    for one compaction more, for readers that began before.  Of the batches the newest is left
    out, as a restarted stream may write it again.
    """
    known = manifest(spark, out)
    upto = -1 if known is None else known["upto"]
    ready = [n for n in batch_numbers_in(spark, out)[:-1] if n > upto]
    if not ready:
        return known
    version = 0 if known is None else known["version"] + 1
    rows = spark.read.option("basePath", out).parquet(*[f"{out}/batch={n}" for n in ready])
    if known is not None:
        rows = rows.unionByName(spark.read.parquet(known["snapshot"]))
    snapshot = f"{out}-folded/{version:08d}-{uuid.uuid4().hex}"
    fold(rows).withColumn("batch", F.lit(ready[-1])).write.parquet(snapshot)
    new = {"version": version, "snapshot": snapshot, "upto": ready[-1], "retired": upto}
    files.put_new(spark, f"{out}-folded/{version:08d}.json", json.dumps(new))
    for number in batch_numbers_in(spark, out):
        if number <= upto:
            files.remove(spark, f"{out}/batch={number}")
    return new


def newest_rows(key: str):
    """Folding of a state: the newest row per key."""

    def fold(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in (key, "batch")]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.col("batch")).alias("_s"))
        return newest.select(key, "_s.*")

    return fold


def last_fields(seq: str = "seq"):
    """Folding of a change log: the last value per id and field."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_id", "field").agg(F.max_by("value", seq).alias("value"), F.max(seq).alias(seq))

    return fold


def fold_state(spark: SparkSession, out: str, key: str, into: str, folded: str | None = None) -> str:
    """Fold the finished batches of a state into one, the newest row per key.

    The batches stay where they are for the query that wrote them; readers given ``into`` skip
    them.  ``folded`` is an earlier result, which is folded again.
    """
    rows = batches(spark, out, folded)
    kept = [c for c in rows.columns if c not in (key, "batch")]
    upto = rows.agg(F.max("batch")).first()[0]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.col("batch")).alias("_s")).select(key, "_s.*")
    newest.write.parquet(f"{into}/batch={upto}")
    return into


def fold_log(spark: SparkSession, log: str, into: str, seq: str = "seq", folded: str | None = None) -> str:
    """Fold the batches of a change log into one, the last value per id and field."""
    rows = batches(spark, log, folded)
    upto = rows.agg(F.max("batch")).first()[0]
    last = rows.groupBy("_id", "field").agg(F.max_by("value", seq).alias("value"), F.max(seq).alias(seq))
    last.write.parquet(f"{into}/batch={upto}")
    return into


def latest_state(spark: SparkSession, out: str, key: str, columns: list[str], folded: str | None = None) -> DataFrame:
    """The newest row per key over all written batches."""
    rows = batches(spark, out, folded)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch")).alias("_s"))
    return newest.select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def upsert(updates: DataFrame, target: str, checkpoint: str, seq: str = "seq", interval: str | None = None):
    """Fold a stream of partial documents into a change log of final field values.

    Every batch is reduced to the last value per id and field (map-side combined) and
    written as its own folder; ``upserted`` applies the log to the base collection.
    """
    fields = updates.select("_id", seq, F.explode(raw_entries(F.col("doc"))).alias("e"))
    fields = fields.select("_id", seq, F.col("e.key").alias("field"), "e.value")

    def save(batch: DataFrame, batch_id: int):
        last = batch.groupBy("_id", "field").agg(
            F.max_by("value", seq).alias("value"), F.max(seq).alias(seq)
        )
        last.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = fields.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, interval).start()


def upserted(base: DataFrame, log: DataFrame, seq: str = "seq") -> DataFrame:
    """The base collection with the change log applied; unknown ids are not inserted."""
    one = F.concat(F.lit("{"), F.to_json(F.col("field").cast("variant")), F.lit(":"), F.col("value"), F.lit("}"))
    changes = log.select("_id", F.col(seq), one.alias("doc"))
    return merge_documents(base, changes, seq)


__all__ = [
    "batches", "compact", "ended_totals", "ending_iterations", "fold_log", "fold_state", "intake", "iteration_state",
    "last_fields", "latest_state", "manifest", "newest_rows", "read_json_stream", "read_parquet_stream", "upsert",
    "upserted", "write_batches",
]
