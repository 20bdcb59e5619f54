"""Parts of JSON texts exactly as they are written.

VARIANT sorts keys and respells numbers, and Spark has no recursive expressions, so what must
keep the text itself goes through these few Arrow-batched functions.  Each reads a text once
from left to right; the texts have been accepted by Spark's own JSON reader before.
"""

from __future__ import annotations

import json
import re
import sys
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a string, a bracket, or a word or number
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^\[\]{}:,"\s]+', re.S)
#: Spark's JSON reader refuses texts nested deeper than 1000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 8_000))


def name_of(token: str) -> str:
    """The key a string token stands for."""
    return json.loads(token, strict=False) if "\\" in token else token[1:-1]


def members(text: str) -> tuple[str, list[tuple[str | None, int, int]]]:
    """The kind of the outermost value ("{", "[" or "") and its members: (key token, start, end)."""
    kind, out, depth, key, begin = "", [], 0, None, None
    for m in _PIECE.finditer(text):
        token = m[0]
        if depth == 0:
            if token not in "[{" or kind:
                break
            kind, depth = token, 1
        elif token in "[{":
            begin = m.start() if depth == 1 else begin
            depth += 1
        elif token in "]}":
            depth -= 1
            if depth == 1:
                out.append((key, begin, m.end()))
                key = None
        elif depth == 1:
            if kind == "{" and key is None:
                key = token
            else:
                out.append((key, m.start(), m.end()))
                key = None
    return kind, out


def parsed(text: str):
    """A value as nested lists: a scalar is its text, containers are (kind, members, keys)."""
    stack = [("", [], [])]
    for token in _PIECE.findall(text):
        kind, values, keys = stack[-1]
        if token in "[{":
            stack.append((token, [], []))
        elif token in "]}":
            if len(stack) > 1:
                stack.pop()
                stack[-1][1].append((kind, values, keys))
        elif kind == "{" and len(keys) == len(values):
            keys.append(token)
        else:
            values.append(token)
    return stack[0][1][0] if stack[0][1] else "null"


def written(value) -> str:
    if isinstance(value, str):
        return value
    kind, values, keys = value
    if kind == "[":
        return "[" + ",".join(map(written, values)) + "]"
    return "{" + ",".join(f"{k}:{written(v)}" for k, v in zip(keys, values, strict=True)) + "}"


def same_scalar(a: str, b: str) -> bool:
    """Whether two scalar tokens say the same."""
    if a == b or a[0] == b[0] == '"':
        return a == b or name_of(a) == name_of(b)
    try:
        return Decimal(a) == Decimal(b)
    except InvalidOperation:
        return False


def aligned(value, original, spelling: bool):
    """``value`` with keys in the order of ``original``; others come last, in their own order.

    Lists are walked when both sides are as long and hold objects only; with ``spelling`` all
    lists of the same length are, and scalars that say the same take the original's text.
    """
    if isinstance(value, str) or isinstance(original, str):
        both = isinstance(value, str) and isinstance(original, str)
        return original if spelling and both and same_scalar(value, original) else value
    kind, values, keys = value
    if kind != original[0]:
        return value
    if kind == "[":
        objects = all(not isinstance(v, str) and v[0] == "{" for side in (values, original[1]) for v in side)
        if len(values) != len(original[1]) or not (objects or spelling):
            return value
        return kind, [aligned(v, o, spelling) for v, o in zip(values, original[1], strict=True)], keys
    own = {name_of(k): (k, v) for k, v in zip(keys, values, strict=True)}
    model = {name_of(k): (k, o) for k, o in zip(original[2], original[1], strict=True)}
    order = [n for n in model if n in own] + [n for n in own if n not in model]
    out = [aligned(own[n][1], model[n][1], spelling) if n in model else own[n][1] for n in order]
    return kind, out, [model[n][0] if spelling and n in model else own[n][0] for n in order]


# white space as Unicode names it
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROL = re.compile(r"\\u00[01][0-9a-f]|\\.")


def trimmed_token(token: str) -> str:
    """A string token without white space around its content, spelled as Spark's JSON writer does."""
    if "\\" not in token:
        return f'"{token[1:-1].strip(_BLANK)}"'
    again = json.dumps(name_of(token).strip(_BLANK), ensure_ascii=False)
    return _CONTROL.sub(lambda m: "\\u" + m[0][2:].upper() if m[0][1] == "u" else m[0], again)


def pruned(value) -> str | None:
    """Text of a parsed value with strings trimmed and empty members dropped; None when empty."""
    if isinstance(value, str):
        text = trimmed_token(value) if value[0] == '"' else value
        return None if text in ('""', "null") else text
    kind, values, keys = value
    kept = [pruned(v) for v in values]
    if kind == "[":
        kept = [t for t in kept if t is not None]
        return f"[{','.join(kept)}]" if kept else None
    named = {k: t for k, t in zip(map(trimmed_token, keys), kept, strict=True) if t is not None and k != '""'}
    return "{" + ",".join(f"{k}:{t}" for k, t in named.items()) + "}" if named else None


def _each(fn, *columns):
    return pd.Series([None if any(x is None for x in row) else fn(*row) for row in zip(*columns, strict=True)])


@F.pandas_udf(T.StringType())
def _align(value: pd.Series, original: pd.Series) -> pd.Series:
    return _each(lambda v, o: written(aligned(parsed(v), parsed(o), False)), value, original)


@F.pandas_udf(T.StringType())
def _respell(value: pd.Series, original: pd.Series) -> pd.Series:
    return _each(lambda v, o: written(aligned(parsed(v), parsed(o), True)), value, original)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _elements(text: pd.Series) -> pd.Series:
    def cut(t):
        kind, found = members(t)
        return [t[a:b] for _, a, b in found] if kind == "[" else None

    return _each(cut, text)


@F.pandas_udf(T.ArrayType(T.StructType().add("key", "string").add("value", "string")))
def _entries(text: pd.Series) -> pd.Series:
    def cut(t):
        kind, found = members(t)
        return [{"key": name_of(k), "value": t[a:b]} for k, a, b in found] if kind == "{" else None

    return _each(cut, text)


@F.pandas_udf(T.StringType())
def _prune(text: pd.Series) -> pd.Series:
    return _each(lambda t: pruned(parsed(t)), text)


@F.pandas_udf(T.StringType())
def _splice(text: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    def put(t, names, new):
        changes = dict(zip(names, new, strict=True))
        kind, found = members(t)
        if kind != "{":
            return t
        out, at, last = [], 0, {name_of(k): n for n, (k, _, _) in enumerate(found)}
        for n, (key, a, b) in enumerate(found):
            name = name_of(key)
            if name in changes and last[name] == n:
                out += [t[at:a], changes.pop(name)]
                at = b
        end = found[-1][2] if found else t.index("{") + 1
        added = [f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in changes.items()]
        out.append(t[at:end])
        if added:
            out.append(("," if found else "") + ",".join(added))
        return "".join(out) + t[end:]

    return _each(put, text, keys, values)


def aligned_text(value: Column, original: Column, spelling: bool = False) -> Column:
    """JSON text ``value`` in the key order (and ``spelling``) of the JSON text ``original``."""
    return F.coalesce((_respell if spelling else _align)(value, original), value)


def pruned_text(text: Column) -> Column:
    """JSON text with strings trimmed and empty members dropped; NULL when empty."""
    return _prune(text)


def raw_elements(text: Column) -> Column:
    """The elements of a list as they are written; NULL for anything else."""
    return _elements(text)


def raw_entries(text: Column) -> Column:
    """(key, value) of an object's members as they are written; NULL for anything else."""
    return _entries(text)


def spliced(text: Column, keys: Column, values: Column) -> Column:
    """An object's text with the values of some keys replaced and new keys put at the end.

    Everything else stays as it is written.  Of a repeated key the last is replaced.
    """
    return _splice(text, keys, values)
