"""Filter, project, sort and page through a collection."""

from __future__ import annotations

import base64
import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import KIND_RANK, TypedLeaf, VariantLeaf, row_leaf
from ..functions.selector import where
from .reshape import project

def _sort_pairs(sort):
    """(field, direction as written) of both forms of a sort, and of plain names."""
    match sort:
        case str():
            yield sort, "asc"
        case dict():
            yield from sort.items()
        case [*parts]:
            # in a list an object says one field; others say nothing
            for part in parts:
                if isinstance(part, str) or isinstance(part, dict) and len(part) == 1:
                    yield from _sort_pairs(part)
        case _:
            raise ValueError("sort must be an object or a list of objects")


def normalize_sort(sort) -> list[tuple[str, int]]:
    """``[(field, 1 | -1)]`` from an object or a list of single-key objects.

    Plain names in a list mean ascending.  ``-1`` is descending in both forms.
    """
    if isinstance(sort, str):
        raise ValueError("sort must be an object or a list of objects")
    falls = lambda way: way.lower().startswith("desc") if isinstance(way, str) else int(way) < 0
    return list({field: -1 if falls(way) else 1 for field, way in _sort_pairs([] if sort is None else sort)}.items())


def sort_keys(df: DataFrame, field: str) -> list[Column]:
    """Ordering expressions for one dotted field, ``:number``/``:string`` optional."""
    name, _, kind = field.partition(":")
    leaf = row_leaf(df).resolve(name)
    if isinstance(leaf, VariantLeaf):
        number = F.when(leaf.is_kind("number"), leaf.number())
        text = F.when(leaf.is_kind("string"), leaf.string())
        if kind == "number":
            return [number]
        if kind == "string":
            return [text]
        ranks = F.create_map(*[F.lit(x) for pair in KIND_RANK.items() for x in pair])
        return [F.try_element_at(ranks, leaf.kind()), number, text, leaf.canonical()]
    if not isinstance(leaf, TypedLeaf):
        return []
    if kind == "number":
        return [leaf.column.try_cast("double")]
    return [leaf.column.cast("string") if kind == "string" else leaf.column]


def sorted_by(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted, each key worked out once a row: a sort evaluates its expressions at every comparison."""
    taken, start = {c.lower() for c in df.columns}, "_sort"
    while any(c.startswith(start) for c in taken):
        start += "_"
    names = [f"{start}{i}" for i in range(len(order))]
    keyed = df.withColumns({name: key for name, (key, _) in zip(names, order, strict=True)})
    ways = [F.col(name).asc() if direction > 0 else F.col(name).desc() for name, (_, direction) in zip(names, order, strict=True)]
    return keyed.orderBy(*ways)


def ordering(df: DataFrame, sort, tiebreak: str | None = "_id") -> list[tuple[Column, int]]:
    """(key, direction) of a full order, the tiebreak last."""
    keys = [(key, direction) for field, direction in normalize_sort(sort) for key in sort_keys(df, field)]
    return [*keys, (F.col(tiebreak), 1)] if tiebreak and tiebreak in df.columns else keys


def _after(column: Column, value: Column, direction: int, is_null: bool) -> Column:
    """Strictly behind ``value`` in sort order; nulls come first ascending, last descending."""
    if is_null:
        return column.isNotNull() if direction > 0 else F.lit(False)
    return column > value if direction > 0 else (column < value) | column.isNull()


def _page_keys(df: DataFrame, sort, tiebreak: str) -> list[tuple[Column, int]]:
    """The typed expressions a page is ordered by, the tiebreak last; document fields too."""
    keys = [(key, direction) for field, direction in normalize_sort(sort) for key in sort_keys(df, field)]
    return [*keys, (F.col(tiebreak), 1)]


def bookmark_of(df: DataFrame, sort, tiebreak: str, page: DataFrame) -> str | None:
    """Bookmark of a page's last row; None when the page is empty.

    ``page`` holds what the sort reads.  Values are kept as text and read back as the type of
    their key, so decimals, timestamps and nulls survive.
    """
    keys = _page_keys(page, sort, tiebreak)
    found = page.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])
    backwards = [F.col(f"k{i}").asc() if d < 0 else F.col(f"k{i}").desc() for i, (_, d) in enumerate(keys)]
    last = found.orderBy(*backwards).select(*[F.col(c).cast("string") for c in found.columns]).limit(1).collect()
    return base64.urlsafe_b64encode(json.dumps(list(last[0])).encode()).decode() if last else None


def behind_bookmark(df: DataFrame, sort, tiebreak: str, bookmark: str) -> DataFrame:
    """Rows after the bookmark: a plain predicate, so earlier pages are not sorted again."""
    texts = json.loads(base64.urlsafe_b64decode(bookmark))
    keys = _page_keys(df, sort, tiebreak)
    types = [f.dataType for f in df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)]).schema]
    branches, equal_so_far = [], F.lit(True)
    for (column, direction), text, dtype in zip(keys, texts, types, strict=True):
        value = F.lit(text).cast(dtype)
        branches.append(equal_so_far & _after(column, value, direction, text is None))
        equal_so_far = equal_so_far & column.eqNullSafe(value)
    return df.where(reduce(operator.or_, branches))


def retrieve(
    df: DataFrame,
    selector: dict | None = None,
    fields=None,
    sort=None,
    limit: int | None = None,
    include_id: bool = False,
    dialect: str = "mango",
    tiebreak: str | None = "_id",
    bookmark: str | None = None,
) -> DataFrame:
    """Documents matching a selector, sorted, limited and cut to the listed fields.

    Nothing is limited unless asked for.  A limit or bookmark always goes with a full order,
    the tiebreak last, so pages neither lose nor repeat rows.
    """
    found = where(df, selector, dialect) if selector else df
    if bookmark:
        found = behind_bookmark(found, sort, tiebreak, bookmark)
    order = ordering(found, sort, tiebreak)
    if order and (sort or limit is not None or bookmark):
        columns, found = found.columns, sorted_by(found, order)
        found = (found if limit is None else found.limit(limit)).select(*[F.col(f"`{c}`") for c in columns])
    elif limit is not None:
        found = found.limit(limit)
    return project(found, fields, include_id) if fields is not None else found
