"""JSON selectors compiled to one Spark predicate.

``where(df, {"status": "O", "total": {"$gt": 1000}})`` reads like a document
query and runs like a hand-written filter: on typed columns every comparison is
a bare column predicate, on VARIANT each one is a guarded path read, and both
forms are visible to predicate pushdown.

Two dialects decide what the documentation of the two store families leaves
different: in ``mango`` absent fields never match ``$ne``/``$nin`` and values of
different kinds are ordered null < boolean < number < string < array < object;
in ``mongo`` absent fields do match, and ranges only match the same kind.
"""

from __future__ import annotations

import operator
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import (
    KIND_RANK,
    Absent,
    Leaf,
    RowLeaf,
    TypedLeaf,
    VariantLeaf,
    as_json,
    json_kind,
    row_leaf,
    variant_literal,
)

DIALECTS = ("mango", "mongo")

# Constructs of the Perl dialect that Java's engine does not have or reads otherwise.
UNSUPPORTED_REGEX = re.compile(r"\(\?R\)|\(\?\||\\K|\(\*[A-Z]|\(\?&|\(\?P[>=]|\(\?\(")

#: whole numbers below this are told apart as doubles
EXACT_IN_DOUBLE = 1 << 53

ORDERINGS = {
    "$lt": operator.lt,
    "$lte": operator.le,
    "$gt": operator.gt,
    "$gte": operator.ge,
}


def all_of(conditions) -> Column:
    conditions = list(conditions)
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def any_of(conditions) -> Column:
    conditions = list(conditions)
    return reduce(operator.or_, conditions) if conditions else F.lit(False)


def holds(condition: Column) -> Column:
    """Two-valued form: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def where(df: DataFrame, selector: dict, dialect: str = "mango", text_columns=None) -> DataFrame:
    """Rows matching the selector."""
    return df.where(compile_selector(selector, row_leaf(df), dialect, text_columns))


def compile_selector(
    selector: dict, root: Leaf, dialect: str = "mango", text_columns=None
) -> Column:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}, expected one of {DIALECTS}")
    return _Selector(dialect, text_columns).document(selector, root)


class _Selector:
    def __init__(self, dialect, text_columns):
        self.dialect, self.text_columns = dialect, text_columns

    # -- structure -----------------------------------------------------------
    def document(self, selector: dict, root: Leaf) -> Column:
        if not isinstance(selector, dict):
            raise ValueError(f"a selector is an object, got {selector!r}")
        return all_of(
            self.combine(key, arg, root) if key.startswith("$") else self.field(root.resolve(key), arg)
            for key, arg in selector.items()
        )

    def combine(self, op: str, arg, leaf: Leaf) -> Column:
        if op in ("$and", "$or", "$nor"):
            if not isinstance(arg, list):
                raise ValueError(f"{op} needs a list of selectors")
            parts = [self.document(s, leaf) if isinstance(s, dict) else self.equal(leaf, s) for s in arg]
            if op == "$nor":
                return all_of(self.refused(s, leaf) for s in arg)
            return all_of(parts) if op == "$and" else any_of(parts)
        if op == "$not":
            return self.refused(arg, leaf)
        if op == "$text":
            return self.text(arg, leaf)
        return self.condition(op, arg, leaf)

    def refused(self, selector, leaf: Leaf) -> Column:
        """Negation: bare where it compares one typed column with values, so that scans see it."""
        if isinstance(selector, dict) and len(selector) == 1:
            ((key, arg),) = selector.items()
            if not key.startswith("$"):
                target = leaf.resolve(key)
                inner = self.field(target, arg)
                return target.column.isNull() | ~inner if self._compares(target, arg) else ~holds(inner)
        inner = self.document(selector, leaf) if isinstance(selector, dict) else self.equal(leaf, selector)
        return leaf.column.isNull() | ~inner if self._compares(leaf, selector) else ~holds(inner)

    @staticmethod
    def _compares(leaf: Leaf, arg) -> bool:
        """Whether a condition on ``leaf`` is unknown only where a typed scalar column is null."""
        if not isinstance(leaf, TypedLeaf) or leaf.fixed_kind not in ("string", "number", "boolean"):
            return False
        values = [arg]
        if isinstance(arg, dict):
            if not arg or set(arg) - {"$eq", "$in", *ORDERINGS}:
                return False
            values = [v for a in arg.values() for v in (a if isinstance(a, list) else [a])]
        return all(json_kind(v) == leaf.fixed_kind for v in values)

    def field(self, leaf: Leaf, arg) -> Column:
        if not isinstance(arg, dict) or not arg:
            return self.equal(leaf, arg)
        return self.document(arg, leaf)

    def condition(self, op: str, arg, leaf: Leaf) -> Column:
        if op == "$exists":
            return leaf.exists() if arg else ~leaf.exists()
        if op in ("$ne", "$nin"):
            return self.negated(op, arg, leaf)
        if isinstance(leaf, Absent):
            return F.lit(False)
        if op == "$eq":
            return self.equal(leaf, arg)
        if op in ORDERINGS:
            return self.ordered(op, leaf, arg)
        if op == "$type":
            if arg not in KIND_RANK:
                raise ValueError(f"unknown type name {arg!r}")
            return self.of_kind(leaf, arg)
        if op == "$in":
            return self.member(leaf, arg)
        if op == "$size":
            return self.array_test(leaf, lambda arr, _: F.size(arr) == F.lit(int(arg)))
        if op == "$all":
            return self.array_test(
                leaf,
                lambda arr, make: all_of(self.contains(arr, make, wanted) for wanted in arg),
            )
        if op == "$elemMatch":
            return self.array_test(
                leaf, lambda arr, make: F.exists(arr, lambda x: holds(self.field(make(x), arg)))
            )
        if op == "$allMatch":
            return self.array_test(
                leaf,
                lambda arr, make: (F.size(arr) > 0)
                & F.forall(arr, lambda x: holds(self.field(make(x), arg))),
            )
        if op == "$keyMapMatch":
            keys = leaf.keys()
            if keys is None:
                return F.lit(False)
            return holds(
                F.exists(keys, lambda k: holds(self.field(TypedLeaf(k, T.StringType()), arg)))
            )
        if op == "$mod":
            return self.modulo(leaf, arg)
        if op == "$regex":
            return self.regex(leaf, arg)
        raise ValueError(f"unknown operator {op}")

    # -- leaves --------------------------------------------------------------
    def of_kind(self, leaf: Leaf, kind: str) -> Column:
        if isinstance(leaf, VariantLeaf):
            return holds(leaf.is_kind(kind))
        return leaf.exists() if leaf.fixed_kind == kind else F.lit(False)

    def equal(self, leaf: Leaf, value) -> Column:
        kind = json_kind(value)
        if isinstance(leaf, Absent):
            return F.lit(False)
        if kind in ("array", "object"):
            return self.equal_deep(leaf, value)
        if isinstance(leaf, VariantLeaf):
            if kind == "null":
                return F.is_variant_null(leaf.variant())
            if kind == "number":
                return leaf.is_kind("number") & self._numbers(leaf, operator.eq, value)
            typed = leaf.string() if kind == "string" else leaf.boolean()
            return leaf.is_kind(kind) & (typed == F.lit(value))
        if leaf.fixed_kind != kind:
            return F.lit(False)
        return leaf.column == leaf.literal(value)

    @staticmethod
    def _numbers(leaf: VariantLeaf, compare, value) -> Column:
        """Compare a document's number; whole numbers a double cannot tell apart compare exactly."""
        rough = compare(leaf.number(), F.lit(float(value)))
        if not isinstance(value, int) or abs(value) < EXACT_IN_DOUBLE:
            return rough
        whole = F.schema_of_variant(leaf.variant()).rlike(r"^(?:BIGINT|DECIMAL\(\d+,0\))$")
        exact = F.try_variant_get(leaf.variant(), "$", "decimal(38,0)")
        return F.coalesce(F.when(whole, compare(exact, F.lit(Decimal(value)).cast("decimal(38,0)"))), rough)

    def equal_deep(self, leaf: Leaf, value) -> Column:
        """Structural equality, unrolled over the literal."""
        if isinstance(value, dict):
            keys = leaf.keys()
            if keys is None:
                return F.lit(False)
            same_keys = (F.size(keys) == len(value)) & self.of_kind(leaf, "object")
            return same_keys & all_of(holds(self.equal(leaf.child(k), v)) for k, v in value.items())

        def same(arr, make):
            return (F.size(arr) == len(value)) & all_of(
                holds(self.equal(make(F.get(arr, F.lit(i))), v)) for i, v in enumerate(value)
            )

        return self.array_test(leaf, same)

    def ordered(self, op: str, leaf: Leaf, value) -> Column:
        kind, compare = json_kind(value), ORDERINGS[op]
        lower_side = op in ("$lt", "$lte")
        others = [
            k for k, r in KIND_RANK.items() if (r < KIND_RANK[kind]) == lower_side and k != kind
        ]
        if not isinstance(leaf, VariantLeaf):
            if leaf.fixed_kind == kind and kind in ("array", "object"):
                return self._by_text(leaf, op, value)
            if leaf.fixed_kind == kind:
                return compare(leaf.column, leaf.literal(value))
            if self.dialect == "mongo":
                return leaf.exists() if (kind == "null" and op == "$gt") else F.lit(False)
            return leaf.exists() if leaf.fixed_kind in others else F.lit(False)
        if kind == "null":
            same = F.is_variant_null(leaf.variant()) if op in ("$lte", "$gte") else F.lit(False)
        elif kind == "number":
            same = leaf.is_kind(kind) & self._numbers(leaf, compare, value)
        elif kind in ("string", "boolean"):
            typed = leaf.string() if kind == "string" else leaf.boolean()
            same = leaf.is_kind(kind) & compare(typed, F.lit(value))
        else:
            same = leaf.is_kind(kind) & self._by_text(leaf, op, value)
        if self.dialect == "mongo" and kind != "null":
            return same
        return same | any_of(leaf.is_kind(k) for k in others) if others else same

    def _by_text(self, leaf: Leaf, op: str, value) -> Column:
        return ORDERINGS[op](leaf.canonical(), as_json(variant_literal(value)))

    def contains(self, arr: Column, make, value) -> Column:
        return F.exists(arr, lambda x: holds(self.equal(make(x), value)))

    def member(self, leaf: Leaf, values) -> Column:
        if not isinstance(values, list):
            raise ValueError("$in and $nin need a list")
        return self._scalar_member(leaf, values) | self.array_test(
            leaf,
            lambda arr, make: F.exists(arr, lambda x: holds(self._scalar_member(make(x), values))),
        ) if self._may_be_array(leaf) else self._scalar_member(leaf, values)

    @staticmethod
    def _may_be_array(leaf: Leaf) -> bool:
        return isinstance(leaf, VariantLeaf) or leaf.fixed_kind == "array"

    def _scalar_member(self, leaf: Leaf, values) -> Column:
        by_kind: dict[str, list] = {}
        for v in values:
            by_kind.setdefault(json_kind(v), []).append(v)
        deep = [self.equal(leaf, v) for k in ("array", "object", "null") for v in by_kind.get(k, [])]
        if isinstance(leaf, VariantLeaf):
            flat = []
            if "number" in by_kind:
                large = [v for v in by_kind["number"] if isinstance(v, int) and abs(v) >= EXACT_IN_DOUBLE]
                wanted = [float(v) for v in by_kind["number"] if v not in large]
                flat += [leaf.is_kind("number") & leaf.number().isin(wanted)] if wanted else []
                flat += [self.equal(leaf, v) for v in large]
            if "string" in by_kind:
                flat.append(leaf.is_kind("string") & leaf.string().isin(by_kind["string"]))
            flat += [self.equal(leaf, v) for v in by_kind.get("boolean", [])]
            return any_of(flat + deep)
        same = by_kind.get(leaf.fixed_kind, [])
        if leaf.fixed_kind in ("array", "object"):
            return any_of(deep)
        return leaf.column.isin([leaf.literal(v) for v in same]) if same else F.lit(False)

    def negated(self, op: str, arg, leaf: Leaf) -> Column:
        plain = self.equal(leaf, arg) if op == "$ne" else (
            F.lit(False) if isinstance(leaf, Absent) else self.member(leaf, arg)
        )
        if self.dialect == "mongo":
            return ~holds(plain)
        if isinstance(leaf, TypedLeaf) and leaf.fixed_kind in ("string", "number", "boolean"):
            return ~plain & leaf.exists()
        return leaf.exists() & ~holds(plain)

    def array_test(self, leaf: Leaf, test) -> Column:
        found = leaf.elements() if isinstance(leaf, (TypedLeaf, VariantLeaf)) else None
        if found is None:
            return F.lit(False)
        arr, make = found
        if isinstance(leaf, VariantLeaf):
            # reading a path as an array gives NULL for every other kind
            return holds(arr.isNotNull() & test(arr, make))
        return holds(test(arr, make))

    def modulo(self, leaf: Leaf, arg) -> Column:
        ok = isinstance(arg, list) and len(arg) == 2
        if not ok or any(isinstance(a, bool) or not isinstance(a, int) for a in arg):
            raise ValueError("$mod needs two integers [divisor, remainder]")
        divisor, remainder = arg
        if isinstance(leaf, VariantLeaf):
            whole = F.schema_of_variant(leaf.variant()) == "BIGINT"
            return whole & (leaf.integer() % F.lit(divisor) == F.lit(remainder))
        if not isinstance(leaf.dtype, T.IntegralType):
            return F.lit(False)
        return leaf.column % F.lit(divisor) == F.lit(remainder)

    def regex(self, leaf: Leaf, pattern: str) -> Column:
        if UNSUPPORTED_REGEX.search(pattern):
            raise ValueError(f"regular expression construct not supported: {pattern!r}")
        if isinstance(leaf, VariantLeaf):
            return leaf.is_kind("string") & leaf.string().rlike(pattern)
        return leaf.column.rlike(pattern) if leaf.fixed_kind == "string" else F.lit(False)

    def text(self, query: str, leaf: Leaf) -> Column:
        words = [w for w in re.split(r"\W+", query.lower()) if w]
        if not words:
            return F.lit(False)
        body = "|".join(re.escape(w) for w in words)
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
        if not isinstance(leaf, RowLeaf):
            raise ValueError("$text searches the whole document, not one field")
        if self.text_columns:
            sources = [F.col(c) for c in self.text_columns]
        elif leaf.document:
            # string leaves of the document: keys are matched first and give nothing;
            # every JSON escape stands for a character that ends a word
            token = r'"(?:[^"\\]|\\.)*+"\s*:|"((?:[^"\\]|\\.)*+)"'
            strings = F.regexp_extract_all(leaf.canonical(), F.lit(token), F.lit(1))
            plain = F.regexp_replace(F.array_join(strings, "\n"), r"\\(u[0-9a-fA-F]{4}|.)", " ")
            sources = [plain]
        else:
            sources = [
                F.col(f"`{f.name}`") for f in leaf.schema if isinstance(f.dataType, T.StringType)
            ]
        return any_of(holds(F.lower(s).rlike(pattern)) for s in sources)
