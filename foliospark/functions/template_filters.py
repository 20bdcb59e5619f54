"""Filters and tests of the template language, name by name.

A filter takes the compiler, the value and its arguments (all ``Val``) and returns
a ``Val``; a test takes values and returns a boolean column.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import as_json, let, text_kind
from .pytext import string_repr, text_of, truthy, variant_of, variant_tojson
from .template import (
    NOT_CONST,
    TemplateError,
    Val,
    as_variant,
    attribute,
    choose,
    compare,
    constant,
    contained,
    element,
    equal,
    is_number,
    is_text,
    is_variant,
    is_whole,
    numeric,
    pairs_of,
    python_mod,
    undefined,
)

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def literal(v: Val | None, default, what: str):
    """A filter argument that has to be known when the plan is built."""
    if v is None:
        return default
    if v.const is NOT_CONST:
        raise TemplateError(f"{what} must be a literal")
    return v.const


def text(col: Column) -> Val:
    return Val(col, STRING)


def over_text(v: Val, fn) -> Val:
    """``fn`` of the text of a value; text that has to be made is made once."""
    return text(fn(v.text()) if is_text(v) else let(v.text(), fn))


# -- strings ------------------------------------------------------------------
# Characters after which a title-cased word starts.
WORD_BREAKS = r"[-\s({\[<]+"


def title_case(s: Column) -> Column:
    parts = F.regexp_extract_all(F.lower(s), F.lit(rf"({WORD_BREAKS}|[^-\s({{\[<]+)"), F.lit(1))
    upper_first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(parts, upper_first), "")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def strip(s: Column, chars: str | None = None) -> Column:
    cls = r"\s" if chars is None else "[" + re.escape(chars).replace("]", r"\]") + "]"
    return F.regexp_replace(s, rf"(?U)^{cls}+|{cls}+$", "")


# Entities and the characters they stand for.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
ESCAPES = [("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("'", "&#39;"), ('"', "&#34;")]


def replace_each(s: Column, pairs) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def strip_tags(s: Column) -> Column:
    bare = F.regexp_replace(s, r"(?s)<!--.*?-->|<.*?>", "")
    return replace_each(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), ENTITIES)


def f_replace(_, v, old, new, count=None):
    n = literal(count, None, "replace count")
    if n is None:
        return text(F.replace(v.text(), old.text(), new.text()))
    parts = F.split(v.text(), re.escape(literal(old, "", "replace")), n + 1)
    return text(F.array_join(parts, literal(new, "", "replace")))


def f_truncate(_, v, length=None, killwords=None, end=None, leeway=None):
    n = literal(length, 255, "truncate length")
    kill, tail = literal(killwords, False, "killwords"), literal(end, "...", "truncate end")
    slack = literal(leeway, 5, "leeway")

    def shorten(s):
        cut = F.substring(s, 1, max(n - len(tail), 0))
        if not kill:
            cut = F.when(cut.contains(" "), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
        return F.when(F.length(s) <= n + slack, s).otherwise(F.concat(cut, F.lit(tail)))

    return over_text(v, shorten)


def f_center(_, v, width=None):
    w = literal(width, 80, "center width")

    def centered(s):
        pad = F.lit(w) - F.length(s)
        left = F.floor(pad / 2).cast("int") + (pad.bitwiseAND(F.lit(w)).bitwiseAND(F.lit(1)))
        padded = F.concat(F.repeat(F.lit(" "), left), s, F.repeat(F.lit(" "), pad - left))
        return F.when(pad > 0, padded).otherwise(s)

    return over_text(v, centered)


# Where text may be broken - blanks, after a hyphen inside a word,
# and around dashes (the rule of Python's standard text wrapper).
WRAP_CHUNK = (
    r"(?U)(\s+|(?<=[\w!\"'&.,?])-{2,}(?=\w)|[^\s]+?(?:-(?:(?<=[^\d\W]{2}-)|(?<=[^\d\W]-[\w!\"'&.,?]-))"
    r"(?=[^\d\W]-?[^\d\W])|(?=\s|$)|(?<=[\w!\"'&.,?])(?=-{2,}\w)))"
)


def wrap_line(line: Column, width: int, long_words: bool) -> Column:
    """Greedy wrapping of one line as a fold over its chunks."""
    chunks = F.regexp_extract_all(line, F.lit(WRAP_CHUNK), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("open"))
    rtrim = lambda s: F.regexp_replace(s, r"(?U)\s+$", "")

    def push(lines, s):
        return F.when(rtrim(s) != "", F.concat(lines, F.array(rtrim(s)))).otherwise(lines)

    def state(lines, s):
        return F.struct(lines.alias("lines"), s.alias("open"))

    def step(acc, chunk):
        lines, current = acc["lines"], acc["open"]
        size, used = F.length(chunk), F.length(current)
        blank = chunk.rlike(r"(?U)^\s+$")
        room = F.greatest(F.lit(width) - used, F.lit(1))
        rest = F.substring(chunk, room + 1, size)
        n_full = F.floor((F.length(rest) - 1) / width).cast("int")
        full = F.transform(
            F.when(n_full > 0, F.sequence(F.lit(0), n_full - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(rest, i * width + 1, F.lit(width)),
        )
        split_long = state(
            F.concat(push(lines, F.concat(current, F.substring(chunk, F.lit(1), room))), full),
            F.substring(rest, n_full * width + 1, F.lit(width)),
        )
        dropped = F.when(blank & (F.size(lines) > 0) & (current == ""), True).otherwise(False)
        next_line = state(push(lines, current), F.when(blank, "").otherwise(chunk))
        fits = (used + size) <= width
        out = F.when(dropped, acc).when(fits, state(lines, F.concat(current, chunk)))
        if long_words:
            out = out.when((size > width) & ~blank, split_long)
        return out.otherwise(next_line)

    folded = F.aggregate(chunks, start, step, lambda acc: push(acc["lines"], acc["open"]))
    return folded


def f_wordwrap(_, v, width=None, break_long_words=None, wrapstring=None):
    w, long_words = literal(width, 79, "wordwrap width"), literal(break_long_words, True, "break_long_words")
    sep = literal(wrapstring, "\n", "wrapstring")
    lines = F.split(F.regexp_replace(v.text(), r"\r?\n$", ""), r"\r?\n")
    return text(F.array_join(F.transform(lines, lambda l: F.array_join(wrap_line(l, w, long_words), sep)), sep))


def f_format(_, v, *args):
    pattern = literal(v, "", "format")
    cols, position = [], 0

    def convert(m):
        nonlocal position
        if m.group(2) == "%":
            return "%%"
        arg = args[position]
        position += 1
        if m.group(2) in "di":
            cols.append(numeric(arg).col.cast("bigint"))
            return f"%{m.group(1)}d"
        if m.group(2) in "feE":
            cols.append(numeric(arg).col.cast("double"))
            flags = m.group(1) if "." in m.group(1) else m.group(1) + ".6"
            return f"%{flags}{m.group(2)}"
        if m.group(2) in "xXo":
            cols.append(numeric(arg).col.cast("bigint"))
            return m.group()
        cols.append(arg.text() if m.group(2) == "s" else string_repr(arg.text()))
        return f"%{m.group(1)}s"

    java = re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)([diouxXeEfsr%])", convert, pattern)
    if position != len(args):
        raise TemplateError(f"format {pattern!r} does not take {len(args)} arguments")
    return text(F.format_string(java, *cols) if cols else F.lit(java.replace("%%", "%")))


# -- lists --------------------------------------------------------------------
def listed(compiler, v: Val) -> Val:
    return compiler.iterated(v)


def length_of(v: Val) -> Column:
    if not v.defined:
        return F.lit(0)
    # a list that filters make is made once: its size alone tells that it is absent
    if is_text(v):
        return F.coalesce(F.length(v.col), F.lit(0))
    if isinstance(v.dtype, (T.ArrayType, T.MapType)):
        return F.greatest(F.size(v.col), F.lit(0))
    if is_variant(v):
        body = as_json(v.col)
        size = F.coalesce(
            F.size(F.try_variant_get(v.col, "$", "array<variant>")),
            F.size(F.json_object_keys(body)),
            F.when(text_kind(body) == "string", F.length(F.try_variant_get(v.col, "$", "string"))),
        )
    elif isinstance(v.dtype, T.StructType):
        size = F.size(F.array_compact(F.array(*[F.when(v.col[n].isNotNull(), 1) for n in v.dtype.fieldNames()])))
    else:
        raise TemplateError(f"{v.dtype.simpleString()} has no length")
    return F.when(v.col.isNotNull(), size).otherwise(0)


def sort_key(v: Val, case_sensitive: bool = False) -> Column:
    """An orderable stand-in; strings compare without case unless asked otherwise."""
    if is_text(v):
        return v.col if case_sensitive else F.lower(v.col)
    if is_variant(v):
        body = as_json(v.col)
        kind = text_kind(body)
        s = F.try_variant_get(v.col, "$", "string")
        return F.struct(
            F.when(kind == "number", F.try_variant_get(v.col, "$", "double")).alias("n"),
            F.when(kind == "string", s if case_sensitive else F.lower(s)).otherwise(body).alias("s"),
        )
    if isinstance(v.dtype, (T.MapType, T.StructType)):
        return as_json(variant_of(v.col, v.dtype))
    return v.col


def path_of(v: Val, dotted) -> Val:
    for part in str(dotted).split("."):
        v = element(v, constant(int(part))) if part.isdigit() else attribute(v, part)
    return v


def by_order(arr: Column, keys: Column, reverse: bool) -> Column:
    """Stable sort of ``arr`` by ``keys``, done on positions so any type can be sorted."""
    tagged = F.transform(keys, lambda k, i: F.struct(k.alias("k"), (-i if reverse else i).alias("i")))
    ordered = F.sort_array(tagged, not reverse)
    return F.transform(ordered, lambda t: F.get(arr, -t["i"] if reverse else t["i"]))


def keyed(arr: Column, dtype, attr, case_sensitive) -> Column:
    def key(x):
        item = Val(x, dtype)
        return sort_key(item if attr is None else path_of(item, attr), case_sensitive)

    return F.transform(arr, key)


def f_sort(compiler, v, reverse=None, case_sensitive=None, attribute=None):
    items = listed(compiler, v)
    down, cased = literal(reverse, False, "reverse"), literal(case_sensitive, False, "case_sensitive")
    attr, kind = literal(attribute, None, "attribute"), items.dtype.elementType
    return replace(items, col=let(items.col, lambda a: by_order(a, keyed(a, kind, attr, cased), down)), const=NOT_CONST)


def f_unique(compiler, v, case_sensitive=None, attribute=None):
    items = listed(compiler, v)
    cased, attr = literal(case_sensitive, False, "case_sensitive"), literal(attribute, None, "attribute")
    kind = items.dtype.elementType

    def keep(a):
        return let(
            keyed(a, kind, attr, cased),
            lambda k: F.filter(a, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1),
        )

    return replace(items, col=let(items.col, keep), const=NOT_CONST)


def f_join(compiler, v, sep=None, attribute=None):
    items, attr = listed(compiler, v), literal(attribute, None, "attribute")
    kind = items.dtype.elementType

    def shown(x):
        item = Val(x, kind)
        return (item if attr is None else path_of(item, attr)).text()

    texts = F.transform(items.col, shown)
    joined = F.array_join(texts, "") if sep is None else F.aggregate(
        texts, F.struct(F.lit("").alias("t"), F.lit(True).alias("first")),
        lambda acc, x: F.struct(F.when(acc["first"], x).otherwise(F.concat(acc["t"], sep.text(), x)).alias("t"), F.lit(False).alias("first")),
        lambda acc: acc["t"],
    ) if sep.const is NOT_CONST else F.array_join(texts, str(sep.const))
    return text(joined)


def f_reverse(compiler, v):
    if is_text(v):
        return text(F.reverse(v.col))
    items = listed(compiler, v)
    return replace(items, col=F.reverse(items.col), const=NOT_CONST)


def f_first(compiler, v):
    items = listed(compiler, v)
    return Val(F.get(items.col, F.lit(0)), items.dtype.elementType)


def f_last(compiler, v):
    items = listed(compiler, v)
    return Val(let(items.col, lambda a: F.get(a, F.size(a) - 1)), items.dtype.elementType)


def cells(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def f_batch(compiler, v, n, fill=None):
    items, size = listed(compiler, v), literal(n, 1, "batch size")
    dtype = items.dtype.elementType

    def rows(a):
        def row(i):
            part = F.slice(a, i * size + 1, size)
            if fill is None:
                return part
            missing = F.greatest((i + 1) * size - F.size(a), F.lit(0))
            return F.concat(part, F.array_repeat(fill.col.cast(dtype), missing))

        return F.transform(cells(F.ceil(F.size(a) / size).cast("int")), row)

    return Val(let(items.col, rows), T.ArrayType(items.dtype))


def f_slice(compiler, v, n, fill=None):
    items, count = listed(compiler, v), literal(n, 1, "slice count")
    dtype = items.dtype.elementType

    def rows(a):
        base, extra = F.floor(F.size(a) / count).cast("int"), F.size(a) % count

        def row(i):
            start = i * base + F.least(i, extra)
            part = F.slice(a, start + 1, base + F.when(i < extra, 1).otherwise(0))
            if fill is None:
                return part
            return F.when(i >= extra, F.concat(part, F.array(fill.col.cast(dtype)))).otherwise(part)

        return F.transform(cells(F.lit(count)), row)

    return Val(let(items.col, rows), T.ArrayType(items.dtype))


def f_map(compiler, v, name=None, *args, attribute=None, default=None):
    items, attr = listed(compiler, v), literal(attribute, None, "attribute")
    kind, out = items.dtype.elementType, {}

    def each(x):
        item = Val(x, kind)
        if attr is not None:
            found = path_of(item, attr)
            if default is not None:
                found = choose(found.col.isNotNull(), replace(found, fail=None), default)
        else:
            found = compiler.filters[literal(name, "", "map")](compiler, item, *args)
        out["dtype"] = found.dtype if found.defined else STRING
        return found.col

    col = F.transform(items.col, each)
    return Val(col, T.ArrayType(out["dtype"]))


def selecting(keep: bool, by_attribute: bool):
    def run(compiler, v, *args):
        items = listed(compiler, v)
        kind, rest = items.dtype.elementType, list(args)
        attr = literal(rest.pop(0), None, "attribute") if by_attribute else None
        name = literal(rest.pop(0), None, "test") if rest else None

        def check(x):
            item = Val(x, kind)
            item = path_of(item, attr) if attr is not None else item
            hit = item.truth() if name is None else compiler.test(name, item, rest)
            return hit if keep else ~hit

        return replace(items, col=F.filter(items.col, check), const=NOT_CONST)

    return run


def f_groupby(compiler, v, attribute, default=None, case_sensitive=None):
    items, attr = listed(compiler, v), literal(attribute, None, "attribute")
    cased, kind = literal(case_sensitive, False, "case_sensitive"), items.dtype.elementType
    out = {}

    def value_of(x):
        found = path_of(Val(x, kind), attr)
        return found if default is None else choose(found.col.isNotNull(), found, default)

    def groups(a):
        keys = F.transform(a, lambda x: sort_key(value_of(x), cased))

        def group(ks, k):
            def labelled(members):
                label = value_of(F.get(members, F.lit(0)))
                out["label"] = label.dtype
                return F.struct(label.col.alias("grouper"), members.alias("list"))

            return let(F.filter(a, lambda x, i: F.get(ks, i).eqNullSafe(k)), labelled)

        return let(keys, lambda ks: F.transform(F.array_sort(F.array_distinct(ks)), lambda k: group(ks, k)))

    col = let(items.col, groups)
    row = T.StructType([T.StructField("grouper", out["label"]), T.StructField("list", items.dtype)])
    return Val(col, T.ArrayType(row))


def f_dictsort(compiler, v, case_sensitive=None, by=None, reverse=None):
    pairs = pairs_of(v)
    cased, part = literal(case_sensitive, False, "case_sensitive"), literal(by, "key", "by")
    field = "_0" if part == "key" else "_1"
    kind = pairs.dtype.elementType[field].dataType
    down = literal(reverse, False, "reverse")

    def ordered(a):
        return by_order(a, F.transform(a, lambda p: sort_key(Val(p[field], kind), cased)), down)

    return replace(pairs, col=let(pairs.col, ordered))


# -- numbers ------------------------------------------------------------------
# What Python accepts as an integer and as a float.
INT_TEXT = r"^\s*[+-]?\d+\s*$"
FLOAT_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_from(v: Val) -> Column:
    """A double from a number or a numeric text; NULL when it is neither."""
    if is_text(v):
        return F.when(v.col.rlike(FLOAT_TEXT), strip(v.col).try_cast("double"))
    if is_variant(v):
        s = F.try_variant_get(v.col, "$", "string")
        kind = text_kind(as_json(v.col))
        return (
            F.when(kind.isin("number", "boolean"), F.try_variant_get(v.col, "$", "double"))
            .when((kind == "string") & s.rlike(FLOAT_TEXT), strip(s).try_cast("double"))
        )
    return numeric(v).col.cast("double") if is_number(v) else F.lit(None).cast("double")


def f_int(_, v, default=None, base=None):
    other = F.lit(literal(default, 0, "int default")).cast("bigint")
    if is_whole(v):
        return Val(F.coalesce(numeric(v).col, other), LONG)
    exact = F.lit(None).cast("bigint")
    if is_text(v):
        exact = F.when(v.col.rlike(INT_TEXT), strip(v.col).try_cast("bigint"))
    return Val(F.coalesce(exact, number_from(v).try_cast("bigint"), other), LONG)


def f_float(_, v, default=None):
    other = F.lit(float(literal(default, 0.0, "float default")))
    return Val(F.coalesce(number_from(v), other), DOUBLE)


def f_abs(_, v):
    n = numeric(v)
    return replace(n, col=F.abs(n.col), const=NOT_CONST)


def f_round(_, v, precision=None, method=None):
    digits, how = literal(precision, 0, "precision"), literal(method, "common", "method")
    x = numeric(v).col.cast("double")
    if how == "common":
        return Val(F.bround(x, digits), DOUBLE)
    scale = float(10**digits)
    turned = F.floor(x * scale) if how == "floor" else F.ceil(x * scale)
    return Val(turned.cast("double") / scale, DOUBLE)


# -- defaults and conversion --------------------------------------------------
def f_default(_, v, value=None, boolean=None):
    other = constant("") if value is None else value
    if literal(boolean, False, "default"):
        return choose(v.truth(), replace(v, fail=None), other)
    return choose(v.col.isNotNull(), replace(v, fail=None), other)


def f_tojson(_, v):
    return text(variant_tojson(F.coalesce(as_variant(v), F.parse_json(F.lit("null")))))


def f_list(compiler, v):
    return listed(compiler, v)


def simple(fn):
    return lambda _, v: over_text(v, fn)


def custom(fn):
    """A user's ``Column -> Column`` function as a filter on the text of a value."""
    return lambda _, v, *args: text(fn(v.text(), *[a.col for a in args]))


FILTERS = {
    "upper": simple(F.upper),
    "lower": simple(F.lower),
    "capitalize": simple(capitalize),
    "title": simple(title_case),
    "trim": lambda _, v, chars=None: text(strip(v.text(), literal(chars, None, "trim"))),
    "striptags": simple(strip_tags),
    "replace": f_replace,
    "truncate": f_truncate,
    "wordwrap": f_wordwrap,
    "center": f_center,
    "format": f_format,
    "length": lambda _, v: Val(length_of(v).cast("bigint"), LONG),
    "count": lambda _, v: Val(length_of(v).cast("bigint"), LONG),
    "first": f_first,
    "last": f_last,
    "reverse": f_reverse,
    "sort": f_sort,
    "unique": f_unique,
    "join": f_join,
    "list": f_list,
    "batch": f_batch,
    "slice": f_slice,
    "map": f_map,
    "select": selecting(True, False),
    "reject": selecting(False, False),
    "selectattr": selecting(True, True),
    "rejectattr": selecting(False, True),
    "groupby": f_groupby,
    "dictsort": f_dictsort,
    "items": lambda _, v: pairs_of(v),
    "abs": f_abs,
    "round": f_round,
    "int": f_int,
    "float": f_float,
    "default": f_default,
    "d": f_default,
    "safe": lambda _, v: v,
    "escape": simple(lambda s: replace_each(s, ESCAPES)),
    "e": simple(lambda s: replace_each(s, ESCAPES)),
    "tojson": f_tojson,
    "string": lambda _, v: text(v.text()),
}


# -- tests --------------------------------------------------------------------
def kind_test(static, kinds):
    """A test on the kind of value: by type when known, by content on VARIANT."""

    def test(v):
        if not v.defined:
            return F.lit(False)
        if is_variant(v):
            return text_kind(as_json(v.col)).isin(*kinds)
        return v.col.isNotNull() if static(v) else F.lit(False)

    return test


def is_integer(v):
    if is_variant(v):
        return F.schema_of_variant(v.col) == "BIGINT"
    return v.col.isNotNull() if isinstance(v.dtype, T.IntegralType) else F.lit(False)


def is_float(v):
    if is_variant(v):
        schema = F.schema_of_variant(v.col)
        return (schema == "DOUBLE") | schema.startswith("DECIMAL")
    return v.col.isNotNull() if isinstance(v.dtype, T.FractionalType) else F.lit(False)


def is_bool(v, wanted):
    if is_variant(v):
        return as_json(v.col) == ("true" if wanted else "false")
    if not isinstance(v.dtype, BOOL.__class__):
        return F.lit(False)
    return v.col if wanted else ~v.col


def cased(v, fn):
    check = lambda s: (s == fn(s)) & (F.lower(s) != F.upper(s))
    return check(v.col) if is_text(v) else let(v.text(), check)


def divisible(v, n):
    return python_mod(numeric(v).col, numeric(n).col) == 0


def ordered_test(op):
    return lambda a, b: compare(op, a, b)


def sequence_test(v):
    if is_variant(v):
        return text_kind(as_json(v.col)).isin("array", "object", "string")
    containers = (T.ArrayType, T.MapType, T.StructType, T.StringType)
    return v.col.isNotNull() if isinstance(v.dtype, containers) else F.lit(False)


TESTS = {
    "defined": lambda v: v.col.isNotNull() if v.defined else F.lit(False),
    "undefined": lambda v: v.col.isNull() if v.defined else F.lit(True),
    "none": lambda v: as_json(v.col) == "null" if is_variant(v) else F.lit(False),
    "boolean": kind_test(lambda v: isinstance(v.dtype, T.BooleanType), ["boolean"]),
    "true": lambda v: is_bool(v, True),
    "false": lambda v: is_bool(v, False),
    "string": kind_test(is_text, ["string"]),
    "number": kind_test(is_number, ["number", "boolean"]),
    "integer": is_integer,
    "float": is_float,
    "mapping": kind_test(lambda v: isinstance(v.dtype, (T.MapType, T.StructType)), ["object"]),
    "sequence": sequence_test,
    "iterable": lambda v: sequence_test(v) if v.defined else F.lit(True),
    "even": lambda v: python_mod(numeric(v).col, F.lit(2)) == 0,
    "odd": lambda v: python_mod(numeric(v).col, F.lit(2)) == 1,
    "divisibleby": divisible,
    "lower": lambda v: cased(v, F.lower),
    "upper": lambda v: cased(v, F.upper),
    "in": lambda a, b: contained(a, b),
    **{n: (lambda a, b: equal(a, b)) for n in ("eq", "equalto", "==")},
    **{n: (lambda a, b: ~F.coalesce(equal(a, b), F.lit(False))) for n in ("ne", "!=")},
    **{n: ordered_test(">") for n in ("gt", "greaterthan", ">")},
    **{n: ordered_test(">=") for n in ("ge", ">=")},
    **{n: ordered_test("<") for n in ("lt", "lessthan", "<")},
    **{n: ordered_test("<=") for n in ("le", "<=")},
}

__all__ = ["FILTERS", "TESTS", "custom", "title_case", "undefined", "text_of", "truthy"]
