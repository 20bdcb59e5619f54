"""Template text and truth of typed values, as native expressions.

Templates print values the way Python does: ``True``, ``1.0``, ``['a', 'b']``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import as_json, text_kind, to_variant

TUPLE_FIELDS = (["_0", "_1"], ["grouper", "list"])


def is_tuple(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.fieldNames() in TUPLE_FIELDS


def float_text(x: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 up to 1e16, else with exponent."""
    x = x.cast("double")
    java = x.cast("string")
    digits = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    # 1.5E-7 -> 1.5e-07, 1.0E20 -> 1e+20
    signed = F.regexp_replace(F.regexp_replace(java, r"(?:\.0)?E(\d)", "e+$1"), r"(?:\.0)?E-", "e-")
    scientific = F.regexp_replace(signed, r"(e[-+])(\d)$", "$10$2")
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def string_repr(s: Column) -> Column:
    """A string with Python's quotes and escapes."""
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(escape))
    double = s.contains("'") & ~s.contains('"')
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def bool_text(b: Column) -> Column:
    return F.when(b, "True").when(~b, "False")


# The walk over a VARIANT is written as SQL text: it is long, and one text is far
# cheaper to hand to the JVM than thousands of column objects.
def sql_text(s: str) -> str:
    for char, escape in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(char, escape)
    return f"'{s}'"


def sql_replace(expression: str, pairs) -> str:
    for old, new in pairs:
        expression = f"replace({expression}, {sql_text(old)}, {sql_text(new)})"
    return expression


def sql_let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_float(java: str, x: str) -> str:
    """``float_text`` of a double ``x`` with its text ``java``, which has an exponent or is tiny."""
    digits = f"regexp_replace(cast(try_cast({java} as decimal(38,21)) as string), '0+$', '')"
    plain = f"regexp_replace({digits}, {sql_text(chr(92) + '.$')}, '.0')"
    signed = f"regexp_replace(regexp_replace({java}, {sql_text(r'(?:[.]0)?E([0-9])')}, 'e+$1'), {sql_text('(?:[.]0)?E-')}, 'e-')"
    scientific = f"regexp_replace({signed}, {sql_text('(e[-+])([0-9])$')}, '$10$2')"
    return (
        f"case when not contains({java}, 'E') then {java} "
        f"when abs({x}) >= 1e-4D and abs({x}) < 1e16D then {plain} else {scientific} end"
    )


def sql_number(v: str, t: str) -> str:
    """A number of a VARIANT; a whole float keeps its ".0", which JSON text drops."""
    double = f"try_variant_get({v}, '$', 'double')"
    return (
        f"case when contains({t}, 'E') or {t} rlike '^-?0[.]0000' then {sql_float(f'cast({double} as string)', double)} "
        f"when not contains({t}, '.') and length({t}) < 19 and startswith(schema_of_variant({v}), 'D') "
        f"then concat({t}, '.0') else {t} end"
    )


def sql_string_repr(s: str) -> str:
    body = sql_replace(s, [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
    quoted_single = f"""concat("'", {sql_replace(body, [("'", chr(92) + "'")])}, "'")"""
    return f"""case when contains({s}, "'") and not contains({s}, '"') then concat('"', {body}, '"') else {quoted_single} end"""


def sql_json_string(s: str) -> str:
    """JSON string in ASCII, with the characters that matter to HTML escaped too."""
    json_text = f"to_json(cast({s} as variant))"
    code = "ascii(c)"
    pair = (
        f"format_string({sql_text('%su%04x%su%04x')}, {sql_text(chr(92))}, shiftright({code} - 65536, 10) + 55296, "
        f"{sql_text(chr(92))}, ({code} - 65536) % 1024 + 56320)"
    )
    one = f"format_string({sql_text('%su%04x')}, {sql_text(chr(92))}, {code})"
    char = f"case when {code} < 128 then c when {code} < 65536 then {one} else {pair} end"
    ascii_text = f"array_join(transform(split({json_text}, ''), c -> {char}), '')"
    text = f"case when {s} rlike {sql_text('[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')} then {ascii_text} else {json_text} end"
    return sql_replace(text, [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("'", "\\u0027")])


# A JSON text in pieces: strings, punctuation, and the words and numbers between.
JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\[\]{}:,"]++'


TYPED_DEPTH = 3  # levels of a VARIANT that are printed from typed values


def walk(variant: Column, string, names: dict, depth: int = TYPED_DEPTH) -> Column:
    """Text of a VARIANT with ", " and ": " separators and the given scalar forms.

    Down to ``depth`` the walk sees typed values.  What is nested deeper is printed piece by
    piece from its JSON text, at any depth; there a whole number written 2.0 prints as 2.
    """
    known = {",": ", ", ":": ": ", "true": names["true"], "false": names["false"], "null": names["null"]}
    cases = " ".join(f"when {sql_text(token)} then {sql_text(text)}" for token, text in known.items())
    brackets = " ".join(f"when {sql_text(b)} then w" for b in "[]{}")
    decoded = string("try_variant_get(p, '$', 'string')")
    piece_scalar = sql_let("try_parse_json(w)", "p", f"if(startswith(w, '\"'), {decoded}, {sql_number('p', 'w')})")
    piece = f"case w {cases} {brackets} else {piece_scalar} end"

    def level(left: int) -> str:
        v, t, m = f"v{left}", f"t{left}", f"m{left}"
        head = f"substring({t}, 1, 1)"
        scalar = (
            f"""case when {head} = '"' then {string(f"try_variant_get({v}, '$', 'string')")} """
            f"when {head} = 't' then '{names['true']}' when {head} = 'f' then '{names['false']}' "
            f"when {head} = 'n' then '{names['null']}' else {sql_number(v, t)} end"
        )
        if left == 0:
            inside = f"array_join(transform(regexp_extract_all({t}, {sql_text(JSON_TOKEN)}, 0), w -> {piece}), '')"
            body = f"case when {head} in ('[', '{{') then {inside} else {scalar} end"
            return sql_let(f"to_json({v})", t, body)
        else:
            listed = f"transform(try_variant_get({v}, '$', 'array<variant>'), x -> struct(cast(null as string) as key, x as value))"
            keyed = f"map_entries(try_variant_get({v}, '$', 'map<string,variant>'))"
            below = sql_let(f"{m}.value", f"v{left - 1}", level(left - 1))
            key = f"if({m}.key is null, '', concat({string(f'{m}.key')}, ': '))"
            # only numbers and the like are printed as JSON here: the JSON writer is dear for each string
            joined = f"array_join(transform(e{left}, {m} -> concat({key}, {below})), ', ')"
            listing = f"try_variant_get({v}, '$', 'array<struct<>>') is not null"
            inside = f"concat(if({listing}, '[', '{{'), {joined}, if({listing}, ']', '}}'))"
            plain = string(f"try_variant_get({v}, '$', 'string')")
            other = sql_let(f"to_json({v})", t, scalar)
            text = f"case when e{left} is not null then {inside} when schema_of_variant({v}) = 'STRING' then {plain} else {other} end"
            return sql_let(f"coalesce({listed}, {keyed})", f"e{left}", text)

    return F.call_function("transform", F.array(variant), F.expr(f"v{depth} -> {level(depth)}"))[0]


def variant_number_text_of(variant: Column) -> Column:
    """Text of a VARIANT that is known to be a number."""
    body = sql_let("to_json(v)", "t", sql_number("v", "t"))
    return F.call_function("transform", F.array(variant), F.expr(f"v -> {body}"))[0]


def variant_repr(variant: Column) -> Column:
    return walk(variant, sql_string_repr, {"true": "True", "false": "False", "null": "None"})


def variant_tojson(variant: Column) -> Column:
    return walk(variant, sql_json_string, {"true": "true", "false": "false", "null": "null"})


def repr_of(col: Column, dtype: T.DataType) -> Column:
    """Python ``repr``; a null inside a container prints as None."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(string_repr(col), F.lit("None"))
    return F.coalesce(text_of(col, dtype, True), F.lit("None"))


def text_of(col: Column, dtype: T.DataType, nested: bool = False) -> Column:
    """Text of a value in template output; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return bool_text(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(col)
    if isinstance(dtype, T.VariantType):
        if nested:
            return variant_repr(col)
        plain = F.when(text_kind(as_json(col)) == "string", F.try_variant_get(col, "$", "string"))
        return F.when(col.isNotNull(), F.coalesce(plain, variant_repr(col)))
    if isinstance(dtype, T.ArrayType):
        inner = F.array_join(F.transform(col, lambda x: repr_of(x, dtype.elementType)), ", ")
        return F.concat(F.lit("["), inner, F.lit("]"))
    if isinstance(dtype, T.MapType):
        inner = F.transform(
            F.map_entries(col),
            lambda e: F.concat(repr_of(e["key"], dtype.keyType), F.lit(": "), repr_of(e["value"], dtype.valueType)),
        )
        return F.concat(F.lit("{"), F.array_join(inner, ", "), F.lit("}"))
    if is_tuple(dtype):
        parts = [repr_of(col[f.name], f.dataType) for f in dtype]
        return F.concat(F.lit("("), parts[0], F.lit(", "), parts[1], F.lit(")"))
    if isinstance(dtype, T.StructType):
        parts = [
            F.when(col[f.name].isNotNull(), F.concat(F.lit(f"'{f.name}': "), repr_of(col[f.name], f.dataType)))
            for f in dtype
        ]
        return F.when(
            col.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
        )
    return col.cast("string")


def truthy(col: Column, dtype: T.DataType) -> Column:
    """Python truth value; absent is false."""
    if isinstance(dtype, T.BooleanType):
        known = col
    elif isinstance(dtype, T.StringType):
        known = col != ""
    elif isinstance(dtype, T.NumericType):
        known = col != 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        known = F.size(col) > 0
    elif isinstance(dtype, T.VariantType):
        text = as_json(col)
        known = ~text.isin("null", "false", '""', "[]", "{}") & ~text.rlike(r"^-?0(\.0+)?(E\d+)?$")
    elif isinstance(dtype, T.StructType):
        known = reduce(lambda a, b: a | b, [col[f.name].isNotNull() for f in dtype], F.lit(False))
    elif isinstance(dtype, T.NullType):
        return F.lit(False)
    else:
        known = col.isNotNull()
    return F.coalesce(known, F.lit(False))


def variant_of(col: Column, dtype: T.DataType) -> Column:
    return to_variant(col, dtype)
