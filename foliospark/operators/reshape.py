"""Projection and reshaping of documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import prune_json, prune_json_inside, trimmed
from ..functions.paths import Leaf, TypedLeaf, VariantLeaf, row_leaf


# -- projection ---------------------------------------------------------------
def normalize_fields(fields) -> list[str] | None:
    """Field list from a list, ``{"fields": [...]}`` or ``{field: include}``."""
    match fields:
        case None | [*_]:
            return fields
        case {"fields": [*listed]}:
            return listed
        case dict():
            return [name for name in fields if fields[name]]
    raise ValueError("fields must be a list of names or an object")


def _field_tree(fields: list[str]) -> dict:
    whole = set(fields)
    tree: dict = {}
    for field in fields:
        parts = field.split(".")
        if any(".".join(parts[:i]) in whole for i in range(1, len(parts))):
            continue  # a listed ancestor already brings it
        node = tree
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = None
    return tree


def _present(leaf: Leaf) -> Column:
    """The value for output, with JSON null turned into absent."""
    if isinstance(leaf, TypedLeaf):
        return leaf.column
    value = leaf.variant()
    if isinstance(leaf, VariantLeaf):
        return F.when(~F.is_variant_null(value), value)
    return value


def _projected(tree: dict, leaf: Leaf) -> Column:
    columns, present = [], F.lit(False)
    for name, below in tree.items():
        child = leaf.child(name)
        value = _present(child) if below is None else _projected(below, child)
        present = present | value.isNotNull()
        columns.append(value.alias(name))
    return F.when(present, F.struct(*columns))


def project(df: DataFrame, fields, include_id: bool = False) -> DataFrame:
    """Documents cut down to the listed dotted fields, nesting kept.

    Absent and null values are left out.  ``include_id`` adds ``_id`` the way one
    of the two store families always does.
    """
    tree = _field_tree(normalize_fields(fields))
    body = F.coalesce(F.to_json(_projected(tree, row_leaf(df))), F.lit("{}"))
    return df.select(*(["_id"] if include_id else []), body.alias("doc"))


# -- keys ---------------------------------------------------------------------
def document_map(doc: Column) -> Column:
    """Top-level keys of a JSON text, in document order."""
    return F.from_json(doc, "map<string,variant>")


def remap_keys(entries: Column, mapping: dict[str, str]) -> Column:
    """Rename keys of a map; others stay, and on collision the later key wins."""
    if not mapping:
        return entries
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    names = F.create_map(*pairs)
    return F.transform_keys(entries, lambda k, _: F.coalesce(F.try_element_at(names, k), k))


def records_to_map(records: Column) -> Column:
    """``[{key, value}, ...]`` as a map; later duplicates win."""
    return F.map_from_entries(F.transform(records, lambda r: F.struct(r["key"], r["value"])))


def map_to_records(entries: Column) -> Column:
    return F.map_entries(entries)


# -- cleaning -----------------------------------------------------------------
def prune_empty(value: Column, dtype: T.DataType, inside: bool = False) -> Column:
    """Trim strings and drop empty members at every level; NULL when nothing is left.

    The expression is generated from the type; numbers and booleans always stay.  ``inside`` an array or
    a map it is native throughout.
    """
    if isinstance(dtype, T.StringType):
        text = trimmed(value)
        return F.when(text != "", text)
    if isinstance(dtype, T.VariantType):
        return F.parse_json((prune_json_inside if inside else prune_json)(value))
    if isinstance(dtype, T.ArrayType):
        kept = F.filter(
            F.transform(value, lambda x: prune_empty(x, dtype.elementType, True)), lambda x: x.isNotNull()
        )
        return F.when(F.size(kept) > 0, kept)
    if isinstance(dtype, T.MapType):
        cleaned = F.transform_values(value, lambda _, v: prune_empty(v, dtype.valueType, True))
        if isinstance(dtype.keyType, T.StringType):
            cleaned = F.transform_keys(cleaned, lambda k, _: trimmed(k))
            cleaned = F.map_filter(cleaned, lambda k, v: v.isNotNull() & (k != ""))
        else:
            cleaned = F.map_filter(cleaned, lambda k, v: v.isNotNull())
        return F.when(F.size(cleaned) > 0, cleaned)
    if isinstance(dtype, T.StructType):
        parts = [(f.name, prune_empty(value[f.name], f.dataType, inside)) for f in dtype]
        present = F.lit(False)
        for _, part in parts:
            present = present | part.isNotNull()
        return F.when(present, F.struct(*[part.alias(name) for name, part in parts]))
    return value


def prune_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, prune_empty(F.col(name), df.schema[name].dataType))


# -- tables from templates ----------------------------------------------------
# Type names a template may use and the column type each stands for.
TEMPLATE_TYPES = {
    "string": T.StringType(),
    "str": T.StringType(),
    "number": T.DoubleType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "integer": T.LongType(),
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
}


# Column types by the type of a sample value; anything else is text.
SAMPLE_TYPES = {bool: T.BooleanType, int: T.LongType, float: T.DoubleType}


def template_type(sample) -> T.DataType:
    """Column type for a template value: a type name, or a sample value."""
    if isinstance(sample, str):
        return TEMPLATE_TYPES.get(sample.strip().lower(), T.StringType())
    return SAMPLE_TYPES.get(type(sample), T.StringType)()


def _row_shape(described, variant: int) -> dict:
    """Column names and sample values of the rows that a template entry describes."""
    match described:
        case {"oneOf": [_, *_] as choices}:
            nearest = sorted((0, variant, len(choices) - 1))[1]
            return _row_shape({"shape": choices[nearest]}, variant)
        case {"shape": {"type": "array", **more}}:
            return {"value": more.get("items", "string")}
        case {"shape": {"type": "object", **more}}:
            return {"key": "string", "value": more.get("additionalProperties", "string")}
        case [dict() as row, *_]:
            return row
        case [value, *_]:
            return {"value": value}
    return {}


def columns_from_template(
    template,
    context_key: str = "org_context",
    target_key: str = "terminology_mapping",
    variant: int = 0,
) -> T.StructType:
    """Row type for the list found at ``template[context_key][target_key]``."""
    document = json.loads(template) if isinstance(template, str) else template
    described = document.get(context_key, {}).get(target_key)
    if isinstance(described, dict):
        described = {k: v for k, v in described.items() if k == "oneOf"}
    types = T.StructType()
    for name, sample in _row_shape(described, variant).items():
        types.add(name, template_type(sample))
    return types


def _blank(dtype: T.DataType, fill: str) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    return F.lit(fill)


def _column_types(columns) -> T.StructType:
    if isinstance(columns, T.StructType):
        return columns
    if isinstance(columns, list):
        columns = {name: "str" for name in columns}
    return T.StructType([T.StructField(n, template_type(str(t))) for n, t in columns.items()])


def typed_rows(spark: SparkSession, n: int, columns, fill: str = "") -> DataFrame:
    """``n`` blank rows with the requested columns; none when ``n <= 0``."""
    types = _column_types(columns)
    return spark.range(max(int(n), 0)).select(*[_blank(f.dataType, fill).alias(f.name) for f in types])


def typed_rows_for(df: DataFrame, count: Column, columns, fill: str = "") -> DataFrame:
    """Blank rows for every row of ``df``, as many as ``count`` says."""
    types = _column_types(columns)
    repeated = df.select("*", F.explode(F.sequence(F.lit(1), count)).alias("row")).where("row > 0")
    repeated = repeated.where(F.col("row") <= count)
    return repeated.select(*df.columns, "row", *[_blank(f.dataType, fill).alias(f.name) for f in types])


# -- labels -------------------------------------------------------------------
def labelled_options(df: DataFrame, name: str, key: str) -> DataFrame:
    """``"name (key)" -> key``; rows without a name are dropped."""
    named = df.where(F.col(name).isNotNull() & (F.col(name) != ""))
    return named.select(
        F.format_string("%s (%s)", F.col(name), F.col(key)).alias("label"), F.col(key).alias("option")
    )


def first_non_empty(columns) -> Column:
    return F.coalesce(*[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns])


def label_rows(df: DataFrame, columns, key: str, order: str) -> DataFrame:
    """First non-empty label per row; of rows sharing a label the last one wins."""
    labelled = df.where(F.col(key).isNotNull()).select(
        first_non_empty(columns).alias("label"), F.col(key).alias("option"), F.col(order).alias("_order")
    )
    return labelled.groupBy("label").agg(F.max_by("option", "_order").alias("option"))
