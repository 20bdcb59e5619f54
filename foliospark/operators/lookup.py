"""Lookups by key: application-side "fetch the first match" loops as joins.

Every dimension is reduced to one row per key before the join, so a join never
multiplies rows.  Its size is measured first: within set bounds it is broadcast, so the
documents are not shuffled on a key of few values; beyond them both sides are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import first_match


#: bounds of a dimension that is broadcast, and parts a key is split into beyond them
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8 << 20
SALTS = 16


def sizes_of(sides: list[DataFrame]) -> list[tuple[int, int]]:
    """Rows and bytes of each side, measured in one job."""
    bytes_of_row = F.octet_length(F.to_json(F.struct("*")))
    each = [side.agg(F.lit(i).alias("i"), F.count("*").alias("n"), F.coalesce(F.sum(bytes_of_row), F.lit(0)).alias("b")) for i, side in enumerate(sides)]
    return [(r["n"], r["b"]) for r in sorted(reduce(DataFrame.union, each).collect())] if each else []


def dimension_join(df: DataFrame, side: DataFrame, key: str, side_key: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Left join of documents with a dimension of one row per key; ``size`` is its rows and bytes where known."""
    rows, bytes_ = size or sizes_of([side])[0]
    if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), F.col(key) == F.col(side_key), "left")
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    spread = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col(key) == F.col(side_key)) & (F.col("_salt") == F.col("_part"))
    return salted.join(spread, same, "left").drop("_salt", "_part")


def lookup_first(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    dimension_key: str,
    values: list[str],
    order: list[str],
    defaults: dict[str, Column] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Left join with the first matching dimension row; defaults where none matches."""
    first = first_match(dimension, dimension_key, order, values)
    renamed = first.select(
        F.col(dimension_key).alias("_lookup_key"), *[F.col(v).alias(f"_lookup_{v}") for v in values],
        F.lit(True).alias("_found"),
    )
    joined = dimension_join(df, renamed, key, "_lookup_key")
    defaults = defaults or {}
    picked = [
        (F.when(F.col("_found"), F.col(f"_lookup_{v}")).otherwise(defaults[v]) if v in defaults else F.col(f"_lookup_{v}")).alias(
            prefix + v
        )
        for v in values
    ]
    return joined.select(*df.columns, *picked)


def lookup_parameters(df, parameters, key="parameter_set_name", default: Column | None = None, order=("_id",)):
    """The parameters of the named set, else the default parameters."""
    default = F.lit(None).cast("string") if default is None else default
    return lookup_first(df, parameters, key, "parameter_set_name", ["parameters"], list(order), {"parameters": default})


def lookup_templates(df, templates, key="system_template_name", order=("_id",)):
    """The named system template, else an empty object."""
    return lookup_first(df, templates, key, "name", ["system_templates"], list(order), {"system_templates": F.lit("{}")})


def lookup_organisation(df, organisations, key="org_id", order=("_id",)):
    """Language and context of the organisation; "English" and an empty object otherwise."""
    found = lookup_first(df, organisations, key, "org_id", ["language", "org_context"], list(order))
    return found.withColumn("language", F.coalesce("language", F.lit("English"))).withColumn(
        "org_context", F.coalesce("org_context", F.lit("{}"))
    )


def assemble_context(df: DataFrame, contexts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """One row per generation document with every context's columns.

    ``contexts`` are ``(dimension, key in df, key in dimension)``, one row per key.
    Where several bring the same column the later context wins, and a value of the
    document itself wins over all of them.
    """
    sources: dict[str, list[Column]] = {}
    joined = df
    sizes = sizes_of([dimension for dimension, _, _ in contexts])
    for i, (dimension, key, dimension_key) in enumerate(contexts):
        names = [c for c in dimension.columns if c != dimension_key]
        renamed = dimension.select(
            F.col(dimension_key).alias(f"_key{i}"), *[F.col(c).alias(f"_c{i}_{c}") for c in names]
        )
        joined = dimension_join(joined, renamed, key, f"_key{i}", sizes[i])
        for c in names:
            sources.setdefault(c, []).append(F.col(f"_c{i}_{c}"))
    for c in df.columns:
        sources.setdefault(c, []).append(F.col(c))
    return joined.select(*[F.coalesce(*reversed(cols)).alias(c) for c, cols in sources.items()])


def lookup_tiers(
    df: DataFrame,
    tiers: list[tuple[str, DataFrame, str]],
    value: str,
    default: Column,
) -> DataFrame:
    """First match of the first tier that has any: ``tier, match, n_matches``.

    Each tier is reduced to one row per key, so the result has one row per request
    however popular a key is; a request no tier knows gets the default.
    """
    best = [
        dimension.groupBy(F.col(dimension_key).alias(f"_k{i}")).agg(F.min(value).alias(f"_m{i}"), F.count("*").alias(f"_n{i}"))
        for i, (_, dimension, dimension_key) in enumerate(tiers)
    ]
    joined = df
    for i, ((key, _, _), side, size) in enumerate(zip(tiers, best, sizes_of(best), strict=True)):
        joined = dimension_join(joined, side, key, f"_k{i}", size)
    n = len(tiers)
    tier = F.coalesce(*[F.when(F.col(f"_k{i}").isNotNull(), F.lit(i + 1)) for i in range(n)], F.lit(0))
    return joined.select(
        *df.columns,
        tier.alias("tier"),
        F.coalesce(*[F.col(f"_m{i}") for i in range(n)], default).alias("match"),
        F.coalesce(*[F.col(f"_n{i}") for i in range(n)], F.lit(0)).cast("bigint").alias("n_matches"),
    )


def pick_default(
    df: DataFrame, options: DataFrame, group: str, preferred: str, option: str, default: Column
) -> DataFrame:
    """The preferred value if the group offers it, else its first option, else the default."""
    offered = options.select(F.col(group).alias("_g"), F.col(option).alias("_o")).distinct()
    first = offered.groupBy("_g").agg(F.min("_o").alias("_first")).withColumnRenamed("_g", "_fg")
    joined = df.join(offered, (F.col(group) == F.col("_g")) & (F.col(preferred) == F.col("_o")), "left")
    joined = joined.join(first, F.col(group) == F.col("_fg"), "left")
    return joined.select(*df.columns, F.coalesce("_o", "_first", default).alias("picked"))


def route_by_type(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """``target`` by type name; an unknown or missing type becomes an error row."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    kind = F.col(column)
    missing = kind.isNull() | (kind == "")
    target = F.when(~missing, F.try_element_at(names, kind))
    error = F.when(missing, F.lit(f"configuration must include '{column}'")).when(
        target.isNull(), F.concat(F.lit("unknown type: "), kind)
    )
    return df.select("*", target.alias("target"), error.alias("error"))


# -- sets ---------------------------------------------------------------------
def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns one of them lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(everything: DataFrame, removed: DataFrame, key: str, excluded=()) -> DataFrame:
    """Distinct keys not in ``removed`` and not excluded by name, sorted."""
    kept = everything.where(~F.col(key).isin(list(excluded))) if excluded else everything
    return kept.select(key).distinct().join(removed.select(key).distinct(), key, "left_anti").orderBy(key)


def first_non_empty_set(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows; asking each only reads until its first row."""
    for frame in frames[:-1]:
        if not frame.isEmpty():
            return frame
    return frames[-1]
