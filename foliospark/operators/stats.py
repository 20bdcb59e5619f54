"""Totals, ordered collections, ranks and schema discovery.

Nothing here gathers an unbounded group: totals and first matches are map-side
combined aggregates, ordered windows run inside chunks of bounded width whose
offsets are added afterwards, and message lists come in segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import as_json, text_kind
from ..sources.files import saved
from .reshape import document_map
from .updates import EMPTY_USAGE_FIELDS, usage_present

SEGMENT = 256  # calls per message segment and positions per window chunk


# -- totals -------------------------------------------------------------------
def token_totals(df: DataFrame, keys=(), usage: str = "usage") -> DataFrame:
    """Sums of the three counters; null when no row has any usage."""
    u = F.col(usage)
    has = F.coalesce(usage_present(u), F.lit(False))
    sums = [
        F.when(F.count_if(has) > 0, F.sum(F.coalesce(u[f], F.lit(0)))).alias(f) for f in EMPTY_USAGE_FIELDS
    ]
    return df.groupBy(*keys).agg(*sums)


def all_hold(df: DataFrame, column: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.every(F.col(column)).alias("all_hold"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order (a range-partitioned sort)."""
    return df.select(column).distinct().orderBy(column)


def tallies(results: DataFrame, **conditions: Column) -> DataFrame:
    return results.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def flatten_lists(df: DataFrame, column: str, keep=()) -> DataFrame:
    """Elements of a list column with their position; rows without elements vanish."""
    return df.select(*keep, F.posexplode(column).alias("position", "item"))


# -- ordered lists ------------------------------------------------------------
def collect_messages(
    rows: DataFrame, key: str, order: list[str], fields: list[str], segment: int = SEGMENT
) -> DataFrame:
    """Message lists in order, one row per key and segment.

    A segment covers ``segment`` consecutive values of the leading order column.
    An ordinary conversation is segment 0; one of any length stays a number of
    bounded rows instead of a single array.
    """
    number = F.floor(F.col(order[0]) / segment).cast("bigint")
    packed = F.struct(*order, *fields)
    lists = rows.groupBy(key, number.alias("segment")).agg(F.array_sort(F.collect_list(packed)).alias("_m"))
    return lists.select(
        key,
        "segment",
        F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("messages"),
    )


# -- running values -----------------------------------------------------------
def chunked_running(
    df: DataFrame, keys: list[str], order: list, chunk: Column, totals: dict[str, Column]
) -> DataFrame:
    """Running sums per key, in order, without one task per key.

    ``chunk`` must not decrease along ``order``.  Sums run inside (key, chunk);
    what earlier chunks hold is added from the per-chunk totals, which are map-side
    combined first.  ``totals`` maps output names to the summed expressions.
    """
    rows = df.withColumn("_chunk", chunk)
    per_chunk = rows.groupBy(*keys, "_chunk").agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(offsets, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[(F.sum(value).over(inside) + F.col(f"_before_{n}")).alias(n) for n, value in totals.items()],
    )


def running_tokens(df: DataFrame, key: str, position: str, tokens: Column, chunk: int = SEGMENT) -> DataFrame:
    """Iteration number (from 1) and token total so far, per conversation."""
    return chunked_running(
        df,
        [key],
        [position],
        F.floor(F.col(position) / chunk),
        {"iteration": F.lit(1).cast("bigint"), "running_total": F.coalesce(tokens, F.lit(0))},
    )


def first_match(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``: an aggregate, not a sort."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in keep])


def in_ranges(df: DataFrame, order: list, name: str = "_range") -> DataFrame:
    """``df`` cut into ranges of ``order`` of about equal size, numbered in ``name``.

    Spark samples the order for the bounds, so a range holds about as many rows whatever the
    values are and however many rows share a key.  The cut is written once to the shared folder.
    """
    return saved(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges")


def batch_numbers(df: DataFrame, keys: list[str], order: list, chunk: Column | None = None, size: int = 100) -> DataFrame:
    """Consecutive batches of ``size`` rows per key.

    Rows are numbered chunk by chunk; without a ``chunk`` they are cut into ranges of (keys, order).
    """
    if chunk is None:
        df, chunk = in_ranges(df, [*keys, *order]), F.col("_range")
    numbered = chunked_running(df, keys, order, chunk, {"_rn": F.lit(1).cast("bigint")})
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn", "_range")


# -- schema discovery ---------------------------------------------------------
def _deep_type(text: Column) -> Column:
    """The same from a JSON text, at any depth; a whole number is an integer here, however written."""
    from ..functions.jsontext import fold_json, quoted

    def scalar(token):
        # an integer literal; decimals and exponents are plain numbers
        whole = F.schema_of_variant(F.try_parse_json(token)) == "BIGINT"
        name = (
            F.when(token.startswith('"'), "string")
            .when(token.isin("true", "false"), "boolean")
            .when(token == "null", "null")
            .otherwise(F.when(whole, "integer").otherwise("number"))
        )
        return F.concat(F.lit('{"type":"'), name, F.lit('"}'))

    def container(kind, members):
        items = F.concat(F.lit('{"type":"array","items":'), F.coalesce(F.get(members, F.lit(0))["value"], F.lit("{}")), F.lit("}"))
        named = F.transform(members, lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["value"]))
        properties = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(named, ","), F.lit("}}"))
        return F.when(kind == "[", items).otherwise(properties)

    return fold_json(text, scalar, container)


def _json_type(variant: Column, depth: int = 3) -> Column:
    """JSON-Schema fragment of a value, as JSON text; an array by its first element.

    Down to ``depth`` from typed values, below from the JSON text.
    """
    from ..functions.jsontext import elements_of, entries_of, quoted
    from ..functions.paths import let

    def of(v: Column, left: int) -> Column:
        return let(as_json(v), lambda text: described(v, text, left))

    def described(v: Column, text: Column, left: int) -> Column:
        kind = text_kind(text)
        # an integer literal; decimals and exponents are plain numbers
        name = F.when(F.schema_of_variant(v) == "BIGINT", "integer").otherwise(kind)
        flat = F.concat(F.lit('{"type":"'), name, F.lit('"}'))
        if left == 0:
            return F.when(kind.isin("array", "object"), _deep_type(text)).otherwise(flat)
        # one place for the next level: the first element, or every entry
        members = F.coalesce(
            F.transform(
                F.slice(elements_of(v), 1, 1),
                lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")),
            ),
            entries_of(v),
        )
        inner = F.transform(
            members,
            lambda m: F.concat(
                F.coalesce(F.concat(quoted(m["key"]), F.lit(":")), F.lit("")), of(m["value"], left - 1)
            ),
        )
        def nested(joined: Column) -> Column:
            items = F.concat(F.lit('{"type":"array","items":'), F.when(joined == "", "{}").otherwise(joined), F.lit("}"))
            properties = F.concat(F.lit('{"type":"object","properties":{'), joined, F.lit("}}"))
            return F.when(kind == "array", items).otherwise(properties)

        body = let(F.array_join(inner, ","), nested)
        return F.when(kind.isin("array", "object"), body).otherwise(flat)

    return of(variant, depth)


def infer_schema(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """``field, type``: per top-level key the type in the first document that has it.

    Only the first ``limit`` documents are looked at; None looks at all.  ``order`` says which document comes first.
    """
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    entries = df.select(*order, F.explode(document_map(F.col("doc"))).alias("field", "value"))
    # with a collecting aggregate beside it the minimum of texts is kept in a hash table a task, before the
    # shuffle; alone it would sort all entries, each with its whole document
    seen = F.collect_set(F.lit(True)).alias("seen")
    first = entries.groupBy("field").agg(F.min_by("value", F.struct(*order)).alias("value"), seen)
    return first.where(F.size("seen") > 0).select("field", _json_type(F.col("value")).alias("type"))
