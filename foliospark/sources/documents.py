"""Document collections: JSON files in, Parquet collections at rest.

A collection is a folder of Parquet with the envelope ``_id, _rev, doc, v``.
``doc`` is the JSON text (keeps key order), ``v`` the same value as VARIANT, so
that selectors read only the paths they name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rawjson import raw_elements
from ..session import qualified, scratch
from . import files

DOC_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("_rev", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("v", T.VariantType()),
    ]
)


# -- reading JSON files -------------------------------------------------------
def _whole_files(spark: SparkSession, paths: list[str], skip_corrupted: bool) -> DataFrame:
    """One row per ``*.json`` file: its path, its text, and the parsed value."""
    raw = spark.read.text(paths, wholetext=True, pathGlobFilter="*.json").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("value").alias("doc"),
    )
    if skip_corrupted:
        raw = raw.where(~F.col("name").contains("_corrupted"))
    return raw.withColumn("v", F.try_parse_json("doc"))


def _split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.where(F.col("v").isNotNull())
    bad = parsed.where(F.col("v").isNull()).select(
        "file", F.lit("not a JSON value").alias("reason")
    )
    return good, bad


def read_json_documents(
    spark: SparkSession, path: str, skip_corrupted: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Every ``*.json`` file of a folder as one document, and the rejected files."""
    if not files.exists(spark, path):
        raise FileNotFoundError(f"folder not found: {path}")
    good, bad = _split_rejects(_whole_files(spark, [path], skip_corrupted))
    return good.select("file", "doc", "v"), bad


def _explode_lists(docs: DataFrame) -> DataFrame:
    """Elements of list-valued documents, as they are written; any other value stays one document."""
    v = F.col("v")
    listed = F.try_variant_get(v, "$", "array<variant>")
    parts = F.when(listed.isNotNull(), raw_elements(F.when(listed.isNotNull(), F.col("doc")))).otherwise(F.array("doc"))
    return docs.select("collection", F.explode(parts).alias("doc")).withColumn(
        "v", F.parse_json("doc")
    )


def read_json_mapping(
    spark: SparkSession, mapping: dict[str, list[str]], skip_corrupted: bool = True
) -> DataFrame:
    """``{collection: [paths]}`` as ``collection, doc, v``.

    A folder gives one document per file; a file (or glob of files) holding a list
    gives one per element.  Paths that do not exist are skipped.
    """
    parts = []
    for collection, paths in mapping.items():
        folders = [p for p in paths if files.is_folder(spark, p)]
        single = [p for p in paths if p not in folders and files.matches(spark, p)]
        for found, explode in ((folders, False), (single, True)):
            if not found:
                continue
            good, _ = _split_rejects(_whole_files(spark, found, skip_corrupted))
            good = good.select(F.lit(collection).alias("collection"), "doc", "v")
            parts.append(_explode_lists(good) if explode else good)
    if not parts:
        return spark.createDataFrame([], "collection string, doc string, v variant")
    return reduce(DataFrame.unionByName, parts)


# Subfolder names and the collections they fill by default.
DEFAULT_FOLDERS = {
    "ORG_CONTEXT": "org_context",
    "MODEL_PARAMETERS": "model_parameters",
    "GENERATION_CONTEXT": "generation_context",
}


def read_folder_tree(
    spark: SparkSession,
    base: str,
    folders: dict[str, str] | None = None,
    skip_corrupted: bool = True,
) -> DataFrame:
    """Subfolders of ``base`` as collections, in one read; missing ones are skipped."""
    folders = DEFAULT_FOLDERS if folders is None else folders
    if not files.exists(spark, base):
        raise FileNotFoundError(f"base path not found: {base}")
    base = base.rstrip("/")
    present = {f: c for f, c in folders.items() if files.is_folder(spark, f"{base}/{f}")}
    if not present:
        return spark.createDataFrame([], "collection string, doc string, v variant")
    good, _ = _split_rejects(
        _whole_files(spark, [f"{base}/{f}" for f in present], skip_corrupted)
    )
    names = F.create_map(*[F.lit(x) for pair in present.items() for x in pair])
    folder = F.url_decode(F.element_at(F.split("file", "/"), -2))
    return good.select(F.try_element_at(names, folder).alias("collection"), "doc", "v")


# -- identity -----------------------------------------------------------------
def assign_ids(df: DataFrame, supplied: Column | None = None) -> DataFrame:
    """Keep ``_id``, else the supplied id, else a random id with today's date.

    Random ids differ when a lost task is run again, so write the result once
    (``insert_docs`` does) before using the ids twice.
    """
    fresh = F.concat(F.uuid(), F.lit("_"), F.date_format(F.current_date(), "ddMMyyyy"))
    choices = [F.col("_id").cast("string")] if "_id" in df.columns else []
    choices += [supplied.cast("string")] if supplied is not None else []
    return df.withColumn("_id", F.coalesce(*choices, fresh))


# -- collections at rest ------------------------------------------------------
def collection_path(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def read_collection(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A stored collection; one that does not exist reads as empty."""
    path = collection_path(store, name)
    if not files.has_data(spark, path):
        return spark.createDataFrame([], DOC_SCHEMA)
    stored = spark.read.parquet(path)
    return live(stored) if "_deleted" in stored.columns else stored


def live(df: DataFrame) -> DataFrame:
    """Rows that are not deletion markers."""
    return df.where(~F.coalesce(F.col("_deleted"), F.lit(False))).drop("_deleted")


def tombstone(df: DataFrame) -> DataFrame:
    """Deletion markers for the rows that carry both identity and revision."""
    both = F.col("_id").isNotNull() & F.col("_rev").isNotNull()
    return df.where(both).select("_id", "_rev", F.lit(True).alias("_deleted"))


def as_envelope(df: DataFrame) -> DataFrame:
    """Bring documents to the stored layout."""
    if "results" in df.columns:
        df = df.select(F.explode("results").alias("doc"))
    out = df if "_id" in df.columns else df.withColumn("_id", F.get_json_object("doc", "$._id"))
    out = out if "_rev" in out.columns else out.withColumn("_rev", F.lit(None).cast("string"))
    return out.select("_id", "_rev", "doc", F.try_parse_json("doc").alias("v"))


def insert_docs(df: DataFrame, store: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Append documents; those whose ``_id`` is taken come back as rejects.

    Of documents that repeat an id the first in input order is stored.

    The decision is written once to the shared folder and both the appended rows
    and the rejects are read from there, so a lost executor cannot change it.
    """
    spark = df.sparkSession
    docs = assign_ids(as_envelope(df)).drop("v").withColumn("_place", F.monotonically_increasing_id())
    staged = scratch(spark, "insert")
    docs.write.parquet(f"{staged}/incoming")
    incoming = spark.read.parquet(f"{staged}/incoming")
    if incoming.isEmpty():
        raise ValueError("no documents to insert")
    # the first supplied wins; only ids and places are grouped, and one row an id is joined back
    counts = incoming.groupBy("_id").agg(F.min("_place").alias("_place"), F.count("*").alias("n"))
    first = counts.join(incoming.select("_id", "_place", F.struct("doc", "_rev").alias("first")), ["_id", "_place"])
    taken = read_collection(spark, store, name).select("_id", F.lit(True).alias("taken"))
    first.join(taken, "_id", "left").select(
        "_id",
        F.col("first._rev").alias("_rev"),
        F.col("first.doc").alias("doc"),
        F.coalesce("taken", F.lit(False)).alias("taken"),
        "n",
    ).write.parquet(f"{staged}/decided")
    decided = spark.read.parquet(f"{staged}/decided")
    accepted = decided.where(~F.col("taken")).select("_id", "_rev", "doc")
    accepted = accepted.withColumn("v", F.try_parse_json("doc"))
    accepted.write.mode("append").parquet(collection_path(store, name))
    rejects = decided.select(
        "_id",
        F.when(F.col("taken"), F.col("n")).otherwise(F.col("n") - 1).alias("rejected"),
        F.when(F.col("taken"), "id exists").otherwise("repeated in input").alias("reason"),
    ).where(F.col("rejected") > 0)
    return accepted, rejects


def collection_counts(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    """Exact document count per existing collection: one scan that reads the deletion marks only."""
    paths = {n: collection_path(store, n) for n in dict.fromkeys(names)}
    paths = {n: p for n, p in paths.items() if files.has_data(spark, p)}
    if not paths:
        return spark.createDataFrame([], "name string, count bigint")
    places = {n: re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", qualified(spark, p)) for n, p in paths.items()}
    single = [places[n] for n, p in paths.items() if not files.is_folder(spark, p)]
    rows = spark.read.schema("_deleted boolean").parquet(*paths.values())
    file = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    place = F.when(file.isin(single), file).otherwise(F.regexp_replace(file, "/[^/]*$", ""))
    live_rows = F.count_if(~F.coalesce(F.col("_deleted"), F.lit(False)))
    counts = rows.groupBy(place.alias("_place")).agg(live_rows.alias("count"))
    named = spark.createDataFrame(list(places.items()), "name string, _at string")
    return named.join(counts, F.col("_at") == F.col("_place"), "left").select("name", F.coalesce("count", F.lit(0)).alias("count"))


def collection_status(
    spark: SparkSession, store: str, names: list[str] | str, return_count: bool = True
) -> DataFrame:
    """One row per name: whether it exists, a marker, and how many documents it has."""
    names = [names] if isinstance(names, str) else list(names)
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    present = collection_counts(spark, store, names)
    joined = wanted.join(present, "name", "left")
    return joined.select(
        "name",
        F.col("count").isNotNull().alias("status"),
        F.when(F.col("count").isNotNull(), "✅").otherwise("❌").alias("display_marker"),
        *([F.coalesce("count", F.lit(0)).alias("documents")] if return_count else []),
    )


def purge(
    spark: SparkSession,
    store: str,
    names: list[str] | str,
    reupload: bool = False,
    mapping: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Remove every document of the named collections; the collections stay.

    Returns ``name, removed, reloaded``.
    """
    if reupload and not mapping:
        raise ValueError("a mapping is required to reload after a purge")
    names = [names] if isinstance(names, str) else list(names)
    counts = {r["name"]: r["count"] for r in collection_counts(spark, store, names).collect()}
    for name in counts:
        empty = spark.createDataFrame([], DOC_SCHEMA)
        empty.write.mode("overwrite").parquet(collection_path(store, name))
    reloaded: dict[str, int] = {}
    if reupload:
        for name, paths in mapping.items():
            docs = read_json_mapping(spark, {name: paths}).select("doc")
            if not docs.isEmpty():
                accepted, _ = insert_docs(docs, store, name)
                reloaded[name] = accepted.count()
    every = list(dict.fromkeys(names + list(reloaded)))
    return spark.createDataFrame(
        [(n, counts.get(n, 0), reloaded.get(n, 0)) for n in every],
        "name string, removed bigint, reloaded bigint",
    )


# -- batch jobs ---------------------------------------------------------------
WRITE_MODES = {"truncate": "overwrite", "append": "append"}


def run_batch(
    spark: SparkSession,
    input_refs: list[str],
    output_ref: str,
    fn,
    write_mode: str = "truncate",
    input_format: str = "parquet",
    output_format: str = "parquet",
) -> DataFrame:
    """Read the referenced inputs, transform, and write the referenced output."""
    if write_mode not in WRITE_MODES:
        raise ValueError(f"write_mode must be one of {sorted(WRITE_MODES)}")
    frame = spark.read.format(input_format).load(input_refs)
    fn(frame).write.format(output_format).mode(WRITE_MODES[write_mode]).save(output_ref)
    return spark.read.format(output_format).load(output_ref)
