"""Updates as transformations: the old state and the changes give the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rawjson import raw_entries, spliced


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"updates need the columns {missing}")


# -- set fields ---------------------------------------------------------------
def last_values(updates: DataFrame, key: str, fields, seq: str) -> DataFrame:
    """Repeated updates of one key folded to one row, the later one winning per field.

    ``has_<field>`` columns say which updates carry a field (default: not null), so
    an update can also set a field to null.  Folding is a map-side combined
    aggregate: a key with very many updates is never gathered.
    """
    require(updates, key, seq)
    folded = []
    for f in fields:
        has = F.col(f"has_{f}") if f"has_{f}" in updates.columns else F.col(f).isNotNull()
        order = F.when(has, F.col(seq))
        folded += [F.max_by(F.col(f), order).alias(f), F.count_if(has).alias(f"has_{f}")]
    counted = updates.where(F.col(key).isNotNull()).groupBy(key).agg(*folded)
    return counted.select(key, *fields, *[(F.col(f"has_{f}") > 0).alias(f"has_{f}") for f in fields])


def merge_set(target: DataFrame, updates: DataFrame, key: str, fields, seq: str) -> tuple[DataFrame, DataFrame]:
    """Set the listed fields of existing rows; everything else stays.

    Returns the new state and one result row per updated key:
    ``matched_count, modified_count, ok``.  Unknown keys are not inserted.
    """
    folded = last_values(updates, key, fields, seq)
    renamed = folded.select(
        F.col(key).alias("_key"),
        *[F.col(f).alias(f"_new_{f}") for f in fields],
        *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields],
    )
    joined = target.join(renamed, F.col(key) == F.col("_key"), "left")
    state = joined.select(
        *[
            F.when(F.coalesce(f"_has_{c}", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in fields
            else F.col(c)
            for c in target.columns
        ]
    )
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"_has_{f}") & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")))
    matched = renamed.join(target.select(key, *fields, F.lit(True).alias("_hit")), F.col(key) == F.col("_key"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    results = matched.select(
        F.col("_key").alias(key),
        hit.cast("int").alias("matched_count"),
        (hit & changed).cast("int").alias("modified_count"),
        hit.alias("ok"),
    )
    return state, results


def merge_documents(target: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """``merge_set`` for documents: top-level keys of the update replace those of the target.

    Values are put in as they are written in the update; the rest of the target's text stays as
    it is.  Keys the target lacks come last, in order of name.
    """
    require(updates, "_id", "doc", seq)
    fields = updates.select("_id", seq, F.explode(raw_entries(F.col("doc"))).alias("e")).select("_id", seq, "e.key", "e.value")
    fields = fields.where(F.col("key") != "_id")
    last = fields.groupBy("_id", "key").agg(F.max_by("value", F.col(seq)).alias("value"))
    # as many entries per id as the document has keys
    changes = last.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("_changes"))
    joined = target.join(changes, "_id", "left")
    changed = F.col("_changes").isNotNull()
    merged = spliced(F.when(changed, F.col("doc")), F.col("_changes.key"), F.col("_changes.value"))
    out = joined.withColumn("doc", F.coalesce(merged, "doc"))
    return out.drop("_changes", "v").withColumn("v", F.try_parse_json("doc"))


# -- replace with revision check ----------------------------------------------
def next_revision(rev: Column, doc: Column) -> Column:
    generation = F.coalesce(F.substring_index(rev, "-", 1).try_cast("int"), F.lit(0)) + 1
    return F.concat(generation.cast("string"), F.lit("-"), F.md5(doc))


def first_revision(doc: Column) -> Column:
    return next_revision(F.lit(None).cast("string"), doc)


def replace_with_rev(target: DataFrame, updates: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace whole documents whose ``_rev`` still matches.

    Returns the new state, the accepted ids with their new revision, and the
    conflicts (stale revision, unknown id, or a second update of the same revision).
    """
    require(updates, "_id", "_rev", "doc")
    order = F.col(seq) if seq else F.col("doc")
    current = target.select("_id", F.col("_rev").alias("_current"))
    judged = updates.join(current, "_id", "left").select(
        "_id", "_rev", "doc", order.alias("_order"),
        (F.col("_rev") == F.col("_current")).alias("_fits"), F.col("_current"),
    )
    fits = F.coalesce("_fits", F.lit(False))
    winners = judged.where(fits).groupBy("_id").agg(
        F.min_by(F.struct("doc", "_rev", "_order"), F.struct("_order", "doc")).alias("w"),
        F.count("*").alias("n"),
    )
    accepted = winners.select(
        "_id", F.col("w.doc").alias("doc"), next_revision(F.col("w._rev"), F.col("w.doc")).alias("_rev")
    )
    renamed = accepted.select("_id", F.col("doc").alias("_doc"), F.col("_rev").alias("_new"))
    joined = target.join(renamed, "_id", "left")
    state = joined.withColumn("doc", F.coalesce("_doc", "doc")).withColumn("_rev", F.coalesce("_new", "_rev"))
    state = state.select(*target.columns) if "v" not in target.columns else state.drop("v").withColumn(
        "v", F.try_parse_json("doc")
    ).select(*target.columns)
    stale = judged.where(~fits).select(
        "_id", "_rev",
        F.when(F.col("_current").isNull(), "unknown id").otherwise("stale revision").alias("reason"),
    )
    repeated = winners.where("n > 1").select(
        "_id", F.col("w._rev").alias("_rev"), F.lit("repeated update").alias("reason")
    )
    return state, accepted, stale.unionByName(repeated)


def write_back_revisions(batch: DataFrame, responses: DataFrame) -> DataFrame:
    """Carry the revision of each successful response back to its document."""
    fresh = responses.where(F.col("rev").isNotNull()).select(
        F.col("id").alias("_id"), F.col("rev").alias("_fresh")
    )
    joined = batch.join(fresh, "_id", "left")
    return joined.withColumn("_rev", F.coalesce("_fresh", "_rev")).drop("_fresh")


def unknown_ids(updates: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Updates that name an id the target does not have."""
    return updates.join(target.select(key).distinct(), key, "left_anti")


# -- append to iteration documents --------------------------------------------
EMPTY_USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_present(usage: Column) -> Column:
    """A usage object counts only when at least one counter is there."""
    present = F.lit(False)
    for f in EMPTY_USAGE_FIELDS:
        present = present | usage[f].isNotNull()
    return present


def append_metadata(state: DataFrame, calls: DataFrame, key: str = "iteration_id", seq: str = "call") -> DataFrame:
    """Metadata of iteration documents after a set of append calls.

    ``state`` has ``total_tokens, iterations_completed, last_token_count,
    last_updated``; ``calls`` has ``usage`` and ``at`` per call.  Tokens add up,
    every call counts as an iteration, the last non-empty usage is remembered.
    """
    has_usage = usage_present(F.col("usage"))
    folded = calls.groupBy(key).agg(
        F.count("*").alias("_calls"),
        F.sum(F.when(has_usage, F.coalesce(F.col("usage.total_tokens"), F.lit(0)))).alias("_tokens"),
        F.max_by("usage", F.when(has_usage, F.col(seq))).alias("_usage"),
        F.max("at").alias("_at"),
    )
    joined = state.join(folded, key, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *[c for c in state.columns if c not in ("total_tokens", "iterations_completed", "last_token_count", "last_updated")],
        (F.coalesce("total_tokens", zero) + F.coalesce("_tokens", zero)).alias("total_tokens"),
        (F.coalesce("iterations_completed", zero) + F.coalesce("_calls", zero)).alias("iterations_completed"),
        F.coalesce("_usage", "last_token_count").alias("last_token_count"),
        F.coalesce("_at", "last_updated").alias("last_updated"),
    )


def append_messages(messages: DataFrame, calls: DataFrame, key: str = "iteration_id", seq: str = "call") -> DataFrame:
    """Message rows after a set of append calls.

    Messages are kept as rows (``key, call, position, role, content``) instead of
    one growing array.  A call with ``replace_messages`` drops everything before it.
    """
    message = F.struct("role", "content")
    added = calls.select(
        key, F.col(seq).alias("call"),
        F.posexplode(F.coalesce("replace_messages", "new_messages")).alias("position", "message"),
    ).select(key, "call", "position", "message.role", "message.content")
    rows = messages.select(key, "call", "position", "role", "content").unionByName(added)
    replaced = calls.where(F.col("replace_messages").isNotNull())
    last = replaced.groupBy(key).agg(F.max(seq).alias("_from"))
    kept = rows.join(last, key, "left").where(F.col("_from").isNull() | (F.col("call") >= F.col("_from")))
    return kept.drop("_from")
