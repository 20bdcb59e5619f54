"""Typed access to one value inside a document.

A ``Leaf`` is the single place where "what kind of JSON value is this" is
decided.  Two layouts are supported with the same interface:

* ``TypedLeaf`` - an ordinary Spark column.  Kinds are known when the plan is
  built, so comparisons stay plain column predicates and reach the Parquet scan.
* ``VariantLeaf`` - a path inside a VARIANT column.  Kinds are known per row, so
  every typed read is guarded (VARIANT casts would silently turn "12" into 12).

SQL NULL always means "absent"; a JSON null is a present value of kind ``null``
and exists only on VARIANT.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND_RANK = {"null": 0, "boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}


def json_kind(value) -> str:
    """JSON kind of a Python literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "object"
    raise TypeError(f"not a JSON value: {value!r}")


def variant_literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    # element_at knows its type once; an index works it out anew, through all of the body, for each row
    return F.element_at(F.transform(F.array(value), body), 1)


def held(value: Column, body) -> Column:
    """``let`` that does not copy what ``body`` gives: for results that hold much."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


def as_json(variant: Column) -> Column:
    """Canonical text of a VARIANT: sorted keys, NULL when absent."""
    return F.to_json(variant)


# What the first character of a JSON text says about its kind.
FIRST_CHARACTER = {
    '"': "string",
    "[": "array",
    "{": "object",
    "n": "null",
    "t": "boolean",
    "f": "boolean",
    **{c: "number" for c in "-0123456789"},
}


FIRST_CHARACTER_MAP = f"map({', '.join(f"'{c}', '{k}'" for c, k in FIRST_CHARACTER.items())})"


def text_kind(text: Column) -> Column:
    """Kind of a canonical JSON text."""
    return F.try_element_at(F.expr(FIRST_CHARACTER_MAP), F.substring(text, 1, 1))


def object_of(variant: Column) -> Column:
    """Members of an object by key, in key order; NULL for anything else."""
    return F.try_variant_get(variant, "$", "map<string,variant>")


def is_object(variant: Column) -> Column:
    """Whether a VARIANT is an object; its members are not read."""
    return F.try_variant_get(variant, "$", "struct<>").isNotNull()


def is_array(variant: Column) -> Column:
    """Whether a VARIANT is an array; its elements are not copied."""
    return F.try_variant_get(variant, "$", "array<struct<>>").isNotNull()


def variant_kind(variant: Column) -> Column:
    """Kind of a VARIANT, told without printing it: printing costs by its size, dear for each string."""

    def scalar(name: Column) -> Column:
        return (
            # a list's isin() leaves by an exception where it finds its value
            F.when((name == "BIGINT") | (name == "DECIMAL"), "number")
            .when(name == "VOID", "null")
            .when(name == "BOOLEAN", "boolean")
            # what JSON has no number for is printed as a string
            .when((name == "DOUBLE") | (name == "FLOAT"), text_kind(as_json(variant)))
            .otherwise("string")
        )

    return (
        F.when(variant.isNull(), F.lit(None).cast("string"))
        .when(is_array(variant), "array")
        .when(is_object(variant), "object")
        .otherwise(let(F.substring_index(F.schema_of_variant(variant), "(", 1), scalar))
    )


def json_path(segments: list[str]) -> str:
    out = "$"
    for s in segments:
        out += f'["{s}"]' if "'" in s else f"['{s}']"
    return out


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def static_kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "number"
    if isinstance(dtype, (T.ArrayType,)):
        return "array"
    if isinstance(dtype, (T.MapType, T.StructType)):
        return "object"
    if isinstance(dtype, T.VariantType):
        return None
    if isinstance(dtype, T.NullType):
        return "null"
    return "string"


def to_variant(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return column
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_variant_object(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("string").cast("variant")
    return column.cast("variant")


class Leaf:
    """Common interface; ``None`` from a typed accessor means "never"."""

    def resolve(self, dotted: str) -> "Leaf":
        leaf = self
        for part in dotted.split("."):
            leaf = leaf.child(part)
        return leaf


class Absent(Leaf):
    def child(self, name):
        return self

    def exists(self):
        return F.lit(False)

    def kind(self):
        return F.lit(None).cast("string")

    def canonical(self):
        return F.lit(None).cast("string")

    def variant(self):
        return F.lit(None).cast("variant")

    fixed_kind = "absent"


class TypedLeaf(Leaf):
    def __init__(self, column: Column, dtype: T.DataType):
        self.column, self.dtype = column, dtype
        self.fixed_kind = static_kind(dtype)

    def child(self, name: str) -> Leaf:
        if isinstance(self.dtype, T.StructType):
            if name not in self.dtype.fieldNames():
                return Absent()
            return leaf_of(self.column.getField(name), self.dtype[name].dataType)
        if isinstance(self.dtype, T.MapType):
            return leaf_of(F.try_element_at(self.column, F.lit(name)), self.dtype.valueType)
        return Absent()

    def exists(self) -> Column:
        return self.column.isNotNull()

    def kind(self) -> Column:
        return F.when(self.column.isNotNull(), self.fixed_kind)

    def canonical(self) -> Column:
        return as_json(self.variant())

    def variant(self) -> Column:
        return to_variant(self.column, self.dtype)

    def elements(self):
        if not isinstance(self.dtype, T.ArrayType):
            return None
        return self.column, lambda x: leaf_of(x, self.dtype.elementType)

    def keys(self) -> Column | None:
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.column)
        if isinstance(self.dtype, T.StructType):
            names = [
                F.when(self.column.getField(n).isNotNull(), n) for n in self.dtype.fieldNames()
            ]
            return F.array_compact(F.array(*names))
        return None

    def literal(self, value) -> Column:
        """A literal of this column's own comparison domain."""
        lit = F.lit(value)
        if self.fixed_kind == "string" and not isinstance(self.dtype, T.StringType):
            return lit.cast(self.dtype)
        return lit


class VariantLeaf(Leaf):
    fixed_kind = None

    def __init__(self, root: Column, segments: list[str] | None = None):
        self.root, self.segments = root, segments or []

    def _get(self, type_name: str) -> Column:
        return F.try_variant_get(self.root, json_path(self.segments), type_name)

    def child(self, name: str) -> Leaf:
        return VariantLeaf(self.root, self.segments + [name])

    def variant(self) -> Column:
        return self._get("variant") if self.segments else self.root

    def exists(self) -> Column:
        return self.variant().isNotNull()

    def kind(self) -> Column:
        return variant_kind(self.variant())

    def canonical(self) -> Column:
        return as_json(self.variant())

    def is_kind(self, kind: str) -> Column:
        head = F.substring(self.canonical(), 1, 1)
        if kind == "number":
            return head.rlike("[-0-9]")
        if kind == "boolean":
            return head.isin("t", "f")
        return head == {"string": '"', "array": "[", "object": "{", "null": "n"}[kind]

    def number(self) -> Column:
        return self._get("double")

    def integer(self) -> Column:
        return self._get("bigint")

    def string(self) -> Column:
        return self._get("string")

    def boolean(self) -> Column:
        return self._get("boolean")

    def elements(self):
        return self._get("array<variant>"), lambda x: VariantLeaf(x)

    def keys(self) -> Column:
        return F.json_object_keys(self.canonical())


def leaf_of(column: Column, dtype: T.DataType) -> Leaf:
    return VariantLeaf(column) if isinstance(dtype, T.VariantType) else TypedLeaf(column, dtype)


class RowLeaf(Leaf):
    """The top of a row: envelope columns first, then the document in ``v``."""

    fixed_kind = "object"

    def __init__(self, schema: T.StructType, document: str | None = None):
        self.schema, self.document = schema, document

    def child(self, name: str) -> Leaf:
        if name in self.schema.fieldNames() and name not in ("doc", self.document):
            return leaf_of(F.col(f"`{name}`"), self.schema[name].dataType)
        if self.document:
            return VariantLeaf(F.col(self.document), [name])
        return Absent()

    def exists(self):
        return F.lit(True)

    def kind(self):
        return F.lit("object")

    def keys(self) -> Column:
        if self.document:
            return F.json_object_keys(F.to_json(F.col(self.document)))
        return F.array(*[F.lit(n) for n in self.schema.fieldNames()])

    def variant(self) -> Column:
        if self.document:
            return F.col(self.document)
        return F.to_variant_object(F.struct(*[F.col(f"`{n}`") for n in self.schema.fieldNames()]))

    def canonical(self) -> Column:
        return as_json(self.variant())


def row_leaf(df: DataFrame) -> RowLeaf:
    """Root of a frame: a document envelope when it has a VARIANT column ``v``."""
    names = df.schema.fieldNames()
    has_doc = "v" in names and isinstance(df.schema["v"].dataType, T.VariantType)
    return RowLeaf(df.schema, "v" if has_doc else None)
