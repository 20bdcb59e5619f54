"""Prompt templates as column expressions.

A template is read once, when the plan is built, and becomes one native string
expression over the columns it names; nothing is interpreted per row.  The
language is the part of the public Jinja syntax that prompt templates use:
output, ``if``, ``for``, ``set``, ``raw``, comments, whitespace control, operators,
tests and filters.

Undefined values follow two rules: a bare undefined name prints as nothing, but
taking an attribute of an undefined value leaves the whole text unrendered.
Failure is carried as a NULL text, which the outermost level turns back into the
template itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsontext import elements_of, entries_of
from .paths import as_json, let, text_kind
from .pytext import is_tuple, text_of, truthy, variant_of

NOT_CONST = object()


class TemplateError(ValueError):
    """A template that cannot be turned into an expression."""


# -- values -------------------------------------------------------------------
@dataclass(frozen=True)
class Val:
    """A typed column; NULL is undefined.  ``fail`` is true where reading it is an error."""

    col: Column
    dtype: T.DataType
    fail: Column | None = None
    const: Any = NOT_CONST
    defined: bool = True

    def text(self) -> Column:
        return F.coalesce(text_of(self.col, self.dtype), F.lit(""))

    def truth(self) -> Column:
        return truthy(self.col, self.dtype)

    def failing(self, *others: Column | None) -> "Val":
        return replace(self, fail=any_fail(self.fail, *others))


UNDEFINED_TYPE = T.NullType()


def undefined() -> Val:
    return Val(F.lit(None).cast("string"), UNDEFINED_TYPE, defined=False)


def constant(value) -> Val:
    if value is None:
        return Val(F.parse_json(F.lit("null")), T.VariantType(), const=None)
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), const=value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), T.LongType(), const=value)
    if isinstance(value, float):
        return Val(F.lit(value), T.DoubleType(), const=value)
    return Val(F.lit(value), T.StringType(), const=value)


def any_fail(*fails: Column | None) -> Column | None:
    known = [f for f in fails if f is not None]
    if not known:
        return None
    out = known[0]
    for f in known[1:]:
        out = out | f
    return out


def is_text(v: Val) -> bool:
    return isinstance(v.dtype, T.StringType)


def is_number(v: Val) -> bool:
    return isinstance(v.dtype, (T.NumericType, T.BooleanType))


def is_whole(v: Val) -> bool:
    return isinstance(v.dtype, (T.IntegralType, T.BooleanType))


def is_variant(v: Val) -> bool:
    return isinstance(v.dtype, T.VariantType)


def as_variant(v: Val) -> Column:
    if not v.defined:
        return F.lit(None).cast("variant")
    return variant_of(v.col, v.dtype)


def numeric(v: Val) -> Val:
    """A number usable in arithmetic; VARIANT and decimals become doubles."""
    if isinstance(v.dtype, T.BooleanType):
        return replace(v, col=v.col.cast("bigint"), dtype=T.LongType())
    if isinstance(v.dtype, T.IntegralType):
        return replace(v, col=v.col.cast("bigint"), dtype=T.LongType())
    if is_variant(v):
        number = F.when(text_kind(as_json(v.col)) == "number", F.try_variant_get(v.col, "$", "double"))
        return replace(v, col=number, dtype=T.DoubleType())
    return replace(v, col=v.col.cast("double"), dtype=T.DoubleType())


def unify(a: Val, b: Val) -> tuple[Val, Val]:
    """Bring two values to one type, keeping how they print."""
    if a.dtype == b.dtype:
        return a, b
    if not a.defined:
        return replace(a, col=F.lit(None).cast(b.dtype), dtype=b.dtype), b
    if not b.defined:
        return a, replace(b, col=F.lit(None).cast(a.dtype), dtype=a.dtype)
    if is_whole(a) and is_whole(b) and T.BooleanType() not in (a.dtype, b.dtype):
        return replace(a, col=a.col.cast("bigint"), dtype=T.LongType()), replace(
            b, col=b.col.cast("bigint"), dtype=T.LongType()
        )
    v = T.VariantType()
    return replace(a, col=as_variant(a), dtype=v), replace(b, col=as_variant(b), dtype=v)


def choose(condition: Column, a: Val, b: Val, fail: Column | None = None) -> Val:
    a, b = unify(a, b)
    branch = None
    if a.fail is not None or b.fail is not None:
        false = F.lit(False)
        branch = F.when(condition, false if a.fail is None else a.fail).otherwise(
            false if b.fail is None else b.fail
        )
    return Val(F.when(condition, a.col).otherwise(b.col), a.dtype, any_fail(fail, branch), defined=a.defined or b.defined)


# -- reading a template -------------------------------------------------------
MARKUP = re.compile(r"(\{\{-?|\{%[-+]?|\{#-?)")
TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~<>|.,:()\[\]{}=]))""",
    re.X | re.S,
)
CLOSERS = {"{{": "}}", "{%": "%}", "{#": "#}"}
RAW_END = re.compile(r"\{%-?\s*endraw\s*-?%\}")


def pieces(source: str):
    """``(kind, body)`` with whitespace control applied; kinds: text, out, tag."""
    if source.endswith("\n"):
        source = source[:-1]
    out, pos, strip_next = [], 0, False

    def add_text(text, strip_end=False):
        nonlocal strip_next
        if strip_next:
            text = text.lstrip()
        if strip_end:
            text = text.rstrip()
        strip_next = False
        if text:
            out.append(("text", text))

    while True:
        m = MARKUP.search(source, pos)
        if not m:
            add_text(source[pos:])
            return out
        opener = m.group()[:2]
        add_text(source[pos : m.start()], strip_end=m.group().endswith("-"))
        end = closing(source, m.end(), CLOSERS[opener])
        body = source[m.end() : end]
        strip_next = body.endswith("-")
        body = body[:-1] if strip_next or body.endswith("+") else body
        pos = end + 2
        if opener == "{#":
            continue
        if opener == "{%" and body.strip() == "raw":
            stop = RAW_END.search(source, pos)
            if not stop:
                raise TemplateError("raw block is not closed")
            add_text(source[pos : stop.start()], strip_end=stop.group().startswith("{%-"))
            pos, strip_next = stop.end(), stop.group().endswith("-%}")
            continue
        out.append(("out" if opener == "{{" else "tag", body.strip()))


def closing(source: str, pos: int, closer: str) -> int:
    """Position of the closing mark outside of string literals."""
    quote = None
    while pos < len(source):
        c = source[pos]
        if quote:
            if c == "\\":
                pos += 1
            elif c == quote:
                quote = None
        elif c in "'\"" and closer != "#}":
            quote = c
        elif source.startswith(closer, pos):
            return pos
        pos += 1
    raise TemplateError(f"missing {closer}")


def tokens(text: str):
    out, pos = [], 0
    text = text.rstrip()
    while pos < len(text):
        m = TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise TemplateError(f"cannot read expression: {text!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e.group(1), e.group(1)), value[1:-1], flags=re.S)
        elif kind == "num":
            value = float(value) if re.search(r"[.eE]", value) else int(value)
        out.append((kind, value))
        pos = m.end()
    return out


class Reader:
    """Expression reader; yields nested tuples."""

    def __init__(self, text: str):
        self.text, self.items, self.at = text, tokens(text), 0

    def peek(self, *values):
        kind, value = self.items[self.at] if self.at < len(self.items) else ("end", None)
        return kind in ("op", "name") and value in values

    def take(self, *values):
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value):
        if not self.take(value):
            raise TemplateError(f"expected {value!r} in {self.text!r}")

    def name(self):
        kind, value = self.items[self.at] if self.at < len(self.items) else ("end", None)
        if kind != "name":
            raise TemplateError(f"expected a name in {self.text!r}")
        self.at += 1
        return value

    def done(self):
        return self.at >= len(self.items)

    def finish(self, node):
        if not self.done():
            raise TemplateError(f"cannot read the end of {self.text!r}")
        return node

    def expression(self):
        node = self.either()
        while self.take("if"):
            condition = self.either()
            other = self.expression() if self.take("else") else None
            node = ("cond", condition, node, other)
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        node, chain = self.sum(), []
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                chain.append((op, self.sum()))
            elif self.peek("not") and self.items[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                chain.append(("not in", self.sum()))
            else:
                return ("compare", node, chain) if chain else node

    def sum(self):
        node = self.joined()
        while op := self.take("+", "-"):
            node = ("math", op, node, self.joined())
        return node

    def joined(self):
        node = self.product()
        while self.take("~"):
            node = ("concat", node, self.product())
        return node

    def product(self):
        node = self.power()
        while op := self.take("*", "/", "//", "%"):
            node = ("math", op, node, self.power())
        return node

    def power(self):
        node = self.signed()
        while self.take("**"):
            node = ("math", "**", node, self.signed())
        return node

    def signed(self, filters=True):
        if op := self.take("-", "+"):
            node = ("sign", op, self.signed(False))
        else:
            node = self.postfix(self.atom())
        return self.filters(node) if filters else node

    def atom(self):
        if self.done():
            raise TemplateError(f"expression ends early: {self.text!r}")
        kind, value = self.items[self.at]
        self.at += 1
        if kind in ("num", "str"):
            while kind == "str" and self.at < len(self.items) and self.items[self.at][0] == "str":
                value += self.items[self.at][1]
                self.at += 1
            return ("const", value)
        if kind == "name":
            words = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return ("const", words[value]) if value in words else ("name", value)
        if value == "(":
            if self.take(")"):
                return ("list", [])
            node = self.expression()
            if self.peek(","):
                items = [node]
                while self.take(",") and not self.peek(")"):
                    items.append(self.expression())
                node = ("list", items)
            self.need(")")
            return node
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return ("list", items)
        if value == "{":
            entries = []
            while not self.take("}"):
                key = self.expression()
                self.need(":")
                entries.append((key, self.expression()))
                if not self.peek("}"):
                    self.need(",")
            return ("dict", entries)
        raise TemplateError(f"unexpected {value!r} in {self.text!r}")

    def arguments(self):
        args, kwargs = [], {}
        while not self.take(")"):
            if (
                self.items[self.at][0] == "name"
                and self.items[self.at + 1 : self.at + 2] == [("op", "=")]
            ):
                key = self.name()
                self.need("=")
                kwargs[key] = self.expression()
            else:
                args.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return args, kwargs

    def postfix(self, node):
        while True:
            if self.take("."):
                kind, value = self.items[self.at]
                self.at += 1
                node = ("item", node, ("const", value)) if kind == "num" else ("attr", node, value)
            elif self.take("["):
                if self.peek(":"):
                    raise TemplateError("slices are not supported")
                node = ("item", node, self.expression())
                self.need("]")
            elif self.take("("):
                node = ("call", node, *self.arguments())
            else:
                return node

    def filters(self, node):
        while True:
            if self.take("|"):
                name = self.name()
                args, kwargs = self.arguments() if self.take("(") else ([], {})
                node = ("filter", node, name, args, kwargs)
            elif self.take("is"):
                negate = bool(self.take("not"))
                name = self.test_name()
                args = []
                if self.take("("):
                    args, _ = self.arguments()
                elif not self.done() and not self.peek(*TEST_ENDS) and self.items[self.at][0] != "op":
                    args = [self.postfix(self.atom())]
                elif self.peek("["):
                    args = [self.postfix(self.atom())]
                node = ("test", node, name, args, negate)
            else:
                return node

    def test_name(self):
        return self.take("==", "!=", "<", "<=", ">", ">=") or self.name()


TEST_ENDS = ("and", "or", "not", "if", "else", "in", "is")


def read_template(source: str) -> list:
    """Nested statements: text, out, if, for, set."""
    stack: list[tuple] = []
    current: list = []

    def tag(body):
        nonlocal current
        word, _, rest = body.partition(" ")
        if word == "if":
            stack.append(("if", [(Reader(rest).finish_expression(), [])], current))
            current = stack[-1][1][0][1]
        elif word in ("elif", "else") and stack and stack[-1][0] == "if":
            condition = Reader(rest).finish_expression() if word == "elif" else None
            stack[-1][1].append((condition, []))
            current = stack[-1][1][-1][1]
        elif word == "else" and stack and stack[-1][0] == "for":
            current = stack[-1][1]["else"]
        elif word == "endif" and stack and stack[-1][0] == "if":
            _, branches, outer = stack.pop()
            outer.append(("if", branches))
            current = outer
        elif word == "for":
            loop = for_header(rest)
            stack.append(("for", loop, current))
            current = loop["body"]
        elif word == "endfor" and stack and stack[-1][0] == "for":
            _, loop, outer = stack.pop()
            outer.append(("for", loop))
            current = outer
        elif word == "set" and "=" in rest:
            reader = Reader(rest)
            name = reader.name()
            reader.need("=")
            current.append(("set", name, reader.finish(reader.expression())))
        else:
            raise TemplateError(f"statement not supported here: {body!r}")

    for kind, body in pieces(source):
        if kind == "text":
            current.append(("text", body))
        elif kind == "out":
            current.append(("out", Reader(body).finish_expression()))
        else:
            tag(body)
    if stack:
        raise TemplateError(f"{stack[-1][0]} block is not closed")
    return current


def for_header(text: str) -> dict:
    reader = Reader(text)
    names = [reader.name()]
    while reader.take(","):
        names.append(reader.name())
    reader.need("in")
    source = reader.either()
    condition = reader.either() if reader.take("if") else None
    reader.finish(None)
    return {"names": names, "in": source, "if": condition, "body": [], "else": []}


def _finish_expression(self):
    return self.finish(self.expression())


Reader.finish_expression = _finish_expression


# -- scope --------------------------------------------------------------------
class Scope:
    """Names visible to a template."""

    def __init__(self, values: dict[str, Val], fallback=None):
        self.values, self.fallback = values, fallback

    def get(self, name: str) -> Val:
        if name in self.values:
            return self.values[name]
        return self.fallback(name) if self.fallback else undefined()

    def extended(self, **values) -> "Scope":
        return Scope({**self.values, **values}, self.fallback)


def flattened(columns: list[tuple[Column, T.StructType]]) -> dict[str, Val]:
    """Context values by name: nested object keys are hoisted, later sources win.

    A later source that lacks a value (NULL) lets the earlier one show through.
    """
    found: dict[str, Val] = {}

    def put(name, val):
        if name in found:
            old, new = unify(found[name], val)
            val = Val(F.coalesce(new.col, old.col), new.dtype)
        found[name] = val

    def hoist(col, dtype):
        for f in dtype:
            put(f.name, Val(col[f.name], f.dataType))
            if isinstance(f.dataType, T.StructType):
                hoist(col[f.name], f.dataType)

    for col, dtype in columns:
        hoist(col, dtype)
    return found


def scope_of(df: DataFrame, contexts: list[str] | None = None) -> Scope:
    """Scope of a frame: context struct columns first, then its other columns."""
    contexts = contexts or []
    own = [f for f in df.schema if f.name not in contexts]
    parts = [(F.col(c), df.schema[c].dataType) for c in contexts]
    parts.append((F.struct(*[F.col(f"`{f.name}`") for f in own]), T.StructType(own)))
    values = flattened(parts)
    for f in own:  # plain columns are read directly, so the scan can prune
        if f.name in values and not isinstance(values[f.name].dtype, T.VariantType) and not contexts:
            values[f.name] = Val(F.col(f"`{f.name}`"), f.dataType)
    return Scope(values)


# -- compiling ----------------------------------------------------------------
class Compiler:
    def __init__(self, filters=None):
        from .template_filters import FILTERS, TESTS

        self.filters = {**FILTERS, **(filters or {})}
        self.custom = set(filters or {})
        self.tests = TESTS

    # statements: (text column, may be NULL on failure, changed names)
    def block(self, nodes: list, scope: Scope) -> tuple[Column, bool, dict]:
        parts, fallible, changed = [], False, {}
        for node in nodes:
            if node[0] == "text":
                parts.append(F.lit(node[1]))
            elif node[0] == "out":
                val = self.value(node[1], scope)
                once = node[1][0] == "filter" and val.fail is None and self.fixed(node[1])
                parts.append(same_for_all(val.text()) if once else guarded(val.text(), val.fail))
                fallible |= val.fail is not None
            elif node[0] == "set":
                val = self.value(node[2], scope)
                if val.fail is not None:
                    parts.append(guarded(F.lit(""), val.fail))
                    fallible, val = True, replace(val, fail=None)
                scope = scope.extended(**{node[1]: val})
                changed[node[1]] = val
            elif node[0] == "if":
                text, fails, updates = self.branches(node[1], scope)
                parts.append(text)
                fallible |= fails
                scope = scope.extended(**updates)
                changed.update(updates)
            else:
                text, fails = self.loop(node[1], scope)
                parts.append(text)
                fallible |= fails
        if not parts:
            return F.lit(""), False, changed
        return (parts[0] if len(parts) == 1 else F.concat(*parts)), fallible, changed

    def branches(self, branches: list, scope: Scope) -> tuple[Column, bool, dict]:
        compiled, fallible = [], False
        for condition, body in branches:
            test = None if condition is None else self.value(condition, scope)
            text, fails, updates = self.block(body, scope)
            fallible |= fails or (test is not None and test.fail is not None)
            compiled.append((test, text, updates))
        if compiled[-1][0] is not None:
            compiled.append((None, F.lit(""), {}))
        names = {n for _, _, u in compiled for n in u}
        result = compiled[-1][1]
        merged = {n: compiled[-1][2].get(n, scope.get(n)) for n in names}
        for test, text, updates in reversed(compiled[:-1]):
            result = guarded(F.when(test.truth(), text).otherwise(result), test.fail)
            merged = {n: choose(test.truth(), updates.get(n, scope.get(n)), merged[n]) for n in names}
        return result, fallible, merged

    def loop(self, loop: dict, scope: Scope) -> tuple[Column, bool]:
        source = self.iterated(self.value(loop["in"], scope))
        element = source.dtype.elementType
        fallible = source.fail is not None
        items = source.col
        if loop["if"] is not None:
            items = F.filter(
                items, lambda x: self.value(loop["if"], self.bind(loop["names"], Val(x, element), scope)).truth()
            )
        other, other_fails, _ = self.block(loop["else"], scope)
        state = {}

        def rendered(arr):
            size = F.size(arr)

            def body(x, i):
                inner = self.bind(loop["names"], Val(x, element), scope)
                inner = inner.extended(loop=LoopVal(arr, i, size, element, depth_of(scope) + 1))
                text, fails, _ = self.block(loop["body"], inner)
                state["fails"] = fails
                return text

            texts = F.transform(arr, body)
            joined = F.array_join(texts, "")
            if state["fails"]:
                joined = let(texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, "")))
            return F.when(size > 0, joined).otherwise(other)

        text = let(F.coalesce(items, F.array().cast(T.ArrayType(element))), rendered)
        return guarded(text, source.fail), fallible or state["fails"] or other_fails

    def bind(self, names: list[str], item: Val, scope: Scope) -> Scope:
        if len(names) == 1:
            return scope.extended(**{names[0]: item})
        if isinstance(item.dtype, T.StructType) and len(item.dtype) == len(names):
            return scope.extended(
                **{n: Val(item.col[f.name], f.dataType) for n, f in zip(names, item.dtype)}
            )
        if isinstance(item.dtype, T.ArrayType):
            return scope.extended(
                **{n: Val(F.get(item.col, F.lit(i)), item.dtype.elementType) for i, n in enumerate(names)}
            )
        if is_variant(item):
            return scope.extended(
                **{n: Val(F.try_variant_get(item.col, f"$[{i}]", "variant"), T.VariantType()) for i, n in enumerate(names)}
            )
        raise TemplateError(f"cannot unpack {item.dtype.simpleString()} into {names}")

    def iterated(self, v: Val) -> Val:
        """What a ``for`` loop runs over."""
        if not v.defined:
            return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()), v.fail)
        if isinstance(v.dtype, T.ArrayType):
            return v
        if isinstance(v.dtype, T.MapType):
            return Val(F.map_keys(v.col), T.ArrayType(v.dtype.keyType), v.fail)
        if is_text(v):
            chars = F.filter(F.split(v.col, ""), lambda c: c != "")
            return Val(chars, T.ArrayType(T.StringType()), v.fail)
        if isinstance(v.dtype, T.StructType):
            keys = F.array_compact(F.array(*[F.when(v.col[n].isNotNull(), n) for n in v.dtype.fieldNames()]))
            return Val(keys, T.ArrayType(T.StringType()), v.fail)
        if is_variant(v):
            keys = F.transform(F.json_object_keys(as_json(v.col)), lambda k: k.cast("variant"))
            text = F.when(text_kind(as_json(v.col)) == "string", F.try_variant_get(v.col, "$", "string"))
            chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("variant"))
            return Val(F.coalesce(elements_of(v.col), keys, chars), T.ArrayType(T.VariantType()), v.fail)
        raise TemplateError(f"cannot loop over {v.dtype.simpleString()}")

    # expressions
    def fixed(self, node) -> bool:
        """Whether no row changes the value: built-in filters over literals."""
        if node[0] == "list":
            return all(self.fixed(n) for n in node[1])
        if node[0] == "filter":
            _, base, name, args, kwargs = node
            return name not in self.custom and all(self.fixed(n) for n in (base, *args, *kwargs.values()))
        return node[0] == "const"

    def value(self, node, scope: Scope) -> Val:
        return getattr(self, "on_" + node[0])(scope, *node[1:])

    def on_const(self, scope, value):
        return constant(value)

    def on_name(self, scope, name):
        return scope.get(name)

    def on_list(self, scope, nodes):
        vals = [self.value(n, scope) for n in nodes]
        if not vals:
            return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        same = all(v.dtype == vals[0].dtype for v in vals) and vals[0].defined
        dtype = vals[0].dtype if same else T.VariantType()
        cols = [v.col if same else F.coalesce(as_variant(v), F.parse_json(F.lit("null"))) for v in vals]
        consts = [v.const for v in vals]
        const = NOT_CONST if any(c is NOT_CONST for c in consts) else consts
        return Val(F.array(*cols), T.ArrayType(dtype), any_fail(*[v.fail for v in vals]), const)

    def on_dict(self, scope, entries):
        keys = [self.value(k, scope) for k, _ in entries]
        vals = [self.value(v, scope) for _, v in entries]
        pairs = [c for k, v in zip(keys, vals) for c in (k.text(), F.coalesce(as_variant(v), F.parse_json(F.lit("null"))))]
        col = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,variant>")
        return Val(col, T.MapType(T.StringType(), T.VariantType()), any_fail(*[v.fail for v in keys + vals]))

    def on_cond(self, scope, condition, a, b):
        test = self.value(condition, scope)
        other = undefined() if b is None else self.value(b, scope)
        return choose(test.truth(), self.value(a, scope), other, test.fail)

    def on_or(self, scope, a, b):
        left, right = self.value(a, scope), self.value(b, scope)
        return choose(left.truth(), replace(left, fail=None), right, left.fail)

    def on_and(self, scope, a, b):
        left, right = self.value(a, scope), self.value(b, scope)
        return choose(left.truth(), right, replace(left, fail=None), left.fail)

    def on_not(self, scope, a):
        v = self.value(a, scope)
        return Val(~v.truth(), T.BooleanType(), v.fail)

    def on_concat(self, scope, a, b):
        left, right = self.value(a, scope), self.value(b, scope)
        return Val(F.concat(left.text(), right.text()), T.StringType(), any_fail(left.fail, right.fail))

    def on_sign(self, scope, op, a):
        v = self.value(a, scope)
        if v.const is not NOT_CONST:
            return constant(-v.const if op == "-" else v.const)
        n = numeric(v)
        return replace(n, col=-n.col) if op == "-" else n

    def on_math(self, scope, op, a, b):
        return arithmetic(op, self.value(a, scope), self.value(b, scope))

    def on_compare(self, scope, first, chain):
        left, result, fail = self.value(first, scope), None, None
        fail = left.fail
        for op, node in chain:
            right = self.value(node, scope)
            fail = any_fail(fail, right.fail)
            one = compare(op, left, right)
            result = one if result is None else result & one
            left = right
        return Val(F.coalesce(result, F.lit(False)), T.BooleanType(), fail)

    def on_attr(self, scope, base, name):
        return attribute(self.value(base, scope), name)

    def on_item(self, scope, base, key):
        v, k = self.value(base, scope), self.value(key, scope)
        if is_text(k) and k.const is not NOT_CONST:
            return attribute(v, k.const)
        return element(v, k)

    def on_call(self, scope, target, args, kwargs):
        values = [self.value(a, scope) for a in args]
        if target == ("name", "range"):
            bounds = [numeric(v).col for v in values]
            start, stop = (F.lit(0).cast("bigint"), bounds[0]) if len(bounds) == 1 else bounds[:2]
            step = bounds[2] if len(bounds) > 2 else F.lit(1).cast("bigint")
            run = F.when(start < stop, F.sequence(start, stop - 1, step)).otherwise(F.array().cast("array<bigint>"))
            return Val(run, T.ArrayType(T.LongType()), any_fail(*[v.fail for v in values]))
        if target[0] != "attr":
            raise TemplateError(f"call not supported: {target}")
        base, method = self.value(target[1], scope), target[2]
        if isinstance(base, LoopVal) and method == "cycle":
            return base.cycle(values)
        if method in ("items", "keys", "values"):
            pairs = pairs_of(base)
            if method == "items":
                return pairs
            part = "_0" if method == "keys" else "_1"
            return Val(F.transform(pairs.col, lambda p: p[part]), T.ArrayType(pairs.dtype.elementType[part].dataType), pairs.fail)
        if method == "get":
            found = attribute(base, values[0].const)
            other = values[1] if len(values) > 1 else constant(None)
            return choose(found.col.isNotNull(), found, other)
        raise TemplateError(f"method not supported: {method}")

    def on_filter(self, scope, node, name, args, kwargs):
        if name not in self.filters:
            raise TemplateError(f"unknown filter {name!r}")
        base = self.value(node, scope)
        values = [self.value(a, scope) for a in args]
        named = {k: self.value(v, scope) for k, v in kwargs.items()}
        out = self.filters[name](self, base, *values, **named)
        skip = base.fail if name not in ("default", "d") else None
        return out.failing(skip, *[v.fail for v in values], *[v.fail for v in named.values()])

    def on_test(self, scope, node, name, args, negate):
        base = self.value(node, scope)
        result = self.test(name, base, [self.value(a, scope) for a in args])
        return Val(~result if negate else result, T.BooleanType(), base.fail)

    def test(self, name: str, base: Val, args: list[Val]) -> Column:
        if name not in self.tests:
            raise TemplateError(f"unknown test {name!r}")
        return F.coalesce(self.tests[name](base, *args), F.lit(False))


def same_for_all(text: Column) -> Column:
    """A text that no row changes, worked out once; Spark folds no expression with lambdas by itself."""
    spark = SparkSession.getActiveSession()
    try:
        return text if spark is None else F.lit(spark.sql("values 1").select(text).first()[0])
    except PySparkException:  # rows that are never rendered may not fail
        return text


def guarded(text: Column, fail: Column | None) -> Column:
    return text if fail is None else F.when(~F.coalesce(fail, F.lit(False)), text)


def depth_of(scope: Scope) -> int:
    loop = scope.values.get("loop")
    return loop.depth if isinstance(loop, LoopVal) else 0


class LoopVal(Val):
    """The ``loop`` variable: position and neighbours inside a ``for``."""

    def __init__(self, arr, index, size, element, depth):
        super().__init__(F.lit(None).cast("string"), UNDEFINED_TYPE)
        object.__setattr__(self, "arr", arr)
        object.__setattr__(self, "i", index)
        object.__setattr__(self, "size", size)
        object.__setattr__(self, "element", element)
        object.__setattr__(self, "depth", depth)

    def attribute(self, name: str) -> Val:
        i, size = self.i, self.size
        counters = {
            "index": i + 1,
            "index0": i,
            "revindex": size - i,
            "revindex0": size - i - 1,
            "length": size,
            "depth": F.lit(self.depth),
            "depth0": F.lit(self.depth - 1),
        }
        if name in counters:
            return Val(counters[name].cast("bigint"), T.LongType())
        if name == "first":
            return Val(i == 0, T.BooleanType())
        if name == "last":
            return Val(i == size - 1, T.BooleanType())
        if name == "previtem":
            return Val(F.get(self.arr, i - 1), self.element)
        if name == "nextitem":
            return Val(F.get(self.arr, i + 1), self.element)
        raise TemplateError(f"loop has no {name!r}")

    def cycle(self, values: list[Val]) -> Val:
        out = values[0]
        for n, v in enumerate(values[1:], 1):
            out = choose(self.i % len(values) == n, v, out)
        return out


def attribute(v: Val, name: str) -> Val:
    """``v.name`` / ``v['name']``; an error where ``v`` itself is undefined."""
    if isinstance(v, LoopVal):
        return v.attribute(name)
    if not v.defined:
        return undefined().failing(F.lit(True))
    fail = any_fail(v.fail, v.col.isNull())
    if isinstance(v.dtype, T.StructType):
        if name not in v.dtype.fieldNames():
            return undefined().failing(fail)
        return Val(v.col[name], v.dtype[name].dataType, fail)
    if isinstance(v.dtype, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.dtype.valueType, fail)
    if is_variant(v):
        from .paths import json_path

        return Val(F.try_variant_get(v.col, json_path([name]), "variant"), T.VariantType(), fail)
    return undefined().failing(fail)


def element(v: Val, k: Val) -> Val:
    if not v.defined:
        return undefined().failing(F.lit(True))
    fail = any_fail(v.fail, k.fail, v.col.isNull())
    if isinstance(v.dtype, T.ArrayType):
        i = numeric(k).col.cast("int")
        at = F.when(i < 0, F.size(v.col) + i).otherwise(i)
        return Val(F.get(v.col, at), v.dtype.elementType, fail)
    if isinstance(v.dtype, T.MapType):
        return Val(F.try_element_at(v.col, k.text()), v.dtype.valueType, fail)
    if is_text(v):
        i = numeric(k).col.cast("int")
        at = F.when(i < 0, F.length(v.col) + i).otherwise(i)
        char = F.substring(v.col, at + 1, F.lit(1))
        return Val(F.when(char != "", char), T.StringType(), fail)
    if is_variant(v):
        if k.const is not NOT_CONST and isinstance(k.const, int) and k.const >= 0:
            return Val(F.try_variant_get(v.col, f"$[{k.const}]", "variant"), T.VariantType(), fail)
        i = numeric(k).col.cast("int")
        arr = elements_of(v.col)
        listed = F.get(arr, F.when(i < 0, F.size(arr) + i).otherwise(i))
        return Val(listed, T.VariantType(), fail)
    if is_tuple(v.dtype) and k.const in (0, 1):
        f = v.dtype.fields[k.const]
        return Val(v.col[f.name], f.dataType, fail)
    return undefined().failing(fail)


def pairs_of(v: Val) -> Val:
    """``items()`` of a mapping as (key, value) tuples, in key order of the source."""
    if not v.defined:
        empty = T.StructType([T.StructField("_0", T.StringType()), T.StructField("_1", T.StringType())])
        return Val(F.array().cast(T.ArrayType(empty)), T.ArrayType(empty), any_fail(v.fail, F.lit(True)))
    fail = any_fail(v.fail, v.col.isNull())

    def typed(value_type):
        return T.ArrayType(T.StructType([T.StructField("_0", T.StringType()), T.StructField("_1", value_type)]))

    if isinstance(v.dtype, T.MapType):
        entries = F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("_0"), e["value"].alias("_1")))
        return Val(entries, typed(v.dtype.valueType), fail)
    if is_variant(v):
        entries = F.transform(entries_of(v.col), lambda e: F.struct(e["key"].alias("_0"), e["value"].alias("_1")))
        return Val(entries, typed(T.VariantType()), fail)
    if isinstance(v.dtype, T.StructType):
        same = len({f.dataType for f in v.dtype}) == 1
        value_type = v.dtype.fields[0].dataType if same else T.VariantType()
        parts = [
            F.when(
                v.col[f.name].isNotNull(),
                F.struct(
                    F.lit(f.name).alias("_0"),
                    (v.col[f.name] if same else variant_of(v.col[f.name], f.dataType)).alias("_1"),
                ),
            )
            for f in v.dtype
        ]
        return Val(F.array_compact(F.array(*parts)), typed(value_type), fail)
    raise TemplateError(f"items() needs a mapping, got {v.dtype.simpleString()}")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    fail = any_fail(a.fail, b.fail)
    if op == "+" and is_text(a) and is_text(b):
        return Val(F.concat(a.col, b.col), T.StringType(), fail)
    if op == "+" and isinstance(a.dtype, T.ArrayType) and isinstance(b.dtype, T.ArrayType):
        return Val(F.concat(a.col, b.col), a.dtype, fail)
    if op == "*" and is_text(a):
        return Val(F.repeat(a.col, numeric(b).col.cast("int")), T.StringType(), fail)
    if op == "%" and is_text(a):
        from .template_filters import FILTERS

        return FILTERS["format"](None, a, b).failing(fail)
    x, y = numeric(a), numeric(b)
    whole = is_whole(x) and is_whole(y)
    dtype = T.LongType() if whole else T.DoubleType()
    xd, yd = x.col.cast("double"), y.col.cast("double")
    if op == "/":
        return Val(xd / yd, T.DoubleType(), fail)
    if op == "//":
        if not whole:
            return Val(F.floor(xd / yd).cast("double"), dtype, fail)
        return Val(F.call_function("div", x.col - python_mod(x.col, y.col), y.col), dtype, fail)
    if op == "%":
        return Val(python_mod(x.col if whole else xd, y.col if whole else yd), dtype, fail)
    if op == "**":
        power = F.pow(xd, yd)
        if whole and b.const is not NOT_CONST and b.const < 0:
            return Val(power, T.DoubleType(), fail)
        return Val(power.cast("bigint") if whole else power, dtype, fail)
    combined = {"+": lambda: x.col + y.col, "-": lambda: x.col - y.col, "*": lambda: x.col * y.col}[op]()
    return Val(combined.cast(dtype), dtype, fail)


def python_mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def compare(op: str, a: Val, b: Val) -> Column:
    if op == "in":
        return contained(a, b)
    if op == "not in":
        return ~F.coalesce(contained(a, b), F.lit(False))
    if op == "!=":
        return ~F.coalesce(equal(a, b), F.lit(False))
    if op == "==":
        return equal(a, b)
    if is_variant(a) and is_text(b):
        a = Val(F.when(text_kind(as_json(a.col)) == "string", F.try_variant_get(a.col, "$", "string")), T.StringType())
    elif is_variant(b) and is_text(a):
        b = Val(F.when(text_kind(as_json(b.col)) == "string", F.try_variant_get(b.col, "$", "string")), T.StringType())
    if is_text(a) and is_text(b):
        x, y = a.col, b.col
    elif a.dtype == b.dtype and not is_variant(a):
        x, y = a.col, b.col
    else:
        x, y = numeric(a).col, numeric(b).col
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def equal(a: Val, b: Val) -> Column:
    if not a.defined or not b.defined:
        other = b if not a.defined else a
        return F.lit(True) if not other.defined else other.col.isNull()
    if is_variant(a) or is_variant(b):
        return as_json(as_variant(a)) == as_json(as_variant(b))
    if is_number(a) and is_number(b):
        return numeric(a).col == numeric(b).col
    if isinstance(a.dtype, type(b.dtype)):
        return a.col == b.col
    return F.lit(False)


def contained(a: Val, b: Val) -> Column:
    if not b.defined:
        return F.lit(False)
    if is_text(b):
        return b.col.contains(a.text())
    if isinstance(b.dtype, T.MapType):
        return F.map_contains_key(b.col, a.text())
    if isinstance(b.dtype, T.StructType):
        names = [F.when(b.col[n].isNotNull(), n) for n in b.dtype.fieldNames()]
        return F.array_contains(F.array_compact(F.array(*names)), a.text())
    if isinstance(b.dtype, T.ArrayType):
        return F.exists(b.col, lambda x: F.coalesce(equal(a, Val(x, b.dtype.elementType)), F.lit(False)))
    if is_variant(b):
        wanted = as_json(as_variant(a))
        kind = text_kind(as_json(b.col))
        return (
            F.when(kind == "array", F.exists(elements_of(b.col), lambda x: as_json(x) == wanted))
            .when(kind == "object", F.array_contains(F.json_object_keys(as_json(b.col)), a.text()))
            .when(kind == "string", F.try_variant_get(b.col, "$", "string").contains(a.text()))
        )
    return F.lit(False)


# -- entry points -------------------------------------------------------------
def has_markup(text: str) -> bool:
    return "{{" in text or "{%" in text


def compile_template(text: str, scope: Scope, variables: dict[str, str] | None = None, filters=None) -> Column:
    """One string column for a template.

    ``variables`` are names whose value is itself a template; they are inlined, so
    templates nested to any depth cost one pass.  A cycle is an error.
    """
    variables = variables or {}
    compiler = Compiler(filters)

    def render(source: str, active: tuple[str, ...]) -> Column:
        if not has_markup(source):
            return F.lit(source)
        inner = Scope(dict(scope.values), scope.fallback)
        outer_get = inner.get

        def get(name):
            if name not in variables:
                return outer_get(name)
            if name in active:
                raise TemplateError(f"templates refer to each other: {' -> '.join([*active, name])}")
            return Val(render(variables[name], (*active, name)), T.StringType())

        nested = NamedScope(inner.values, get)
        column, fallible, _ = compiler.block(read_template(source), nested)
        return F.coalesce(column, F.lit(source)) if fallible else column

    return render(text, ())


class NamedScope(Scope):
    """A scope that asks ``lookup`` for every name not set inside the template."""

    def __init__(self, base: dict, lookup, local: dict | None = None):
        super().__init__(base)
        self.lookup, self.local = lookup, local or {}

    def get(self, name):
        return self.local[name] if name in self.local else self.lookup(name)

    def extended(self, **values):
        merged = {**self.local, **values}
        return NamedScope({**self.values, **values}, self.lookup, merged)


def render_value(value, scope: Scope, variables=None, filters=None):
    """Render every template string inside a plain object or list; the rest is kept."""
    if isinstance(value, str):
        return compile_template(value, scope, variables, filters) if has_markup(value) else F.lit(value)
    if isinstance(value, dict):
        return F.struct(*[render_value(v, scope, variables, filters).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[render_value(v, scope, variables, filters) for v in value])
    return F.lit(value)


def render(
    df: DataFrame,
    templates: str | dict[str, str],
    output: str = "text",
    contexts: list[str] | None = None,
    key: str | None = None,
    variables: dict[str, str] | None = None,
    filters=None,
) -> DataFrame:
    """Add the rendered text, and whether it still holds markup that came from data.

    ``templates`` is one template, or a dimension ``{name: template}`` chosen per row
    by the column ``key``; rows with an unknown name get NULL.
    """
    scope = scope_of(df, contexts)
    if isinstance(templates, str):
        text = compile_template(templates, scope, variables, filters)
    else:
        text = F.lit(None).cast("string")
        for name, source in templates.items():
            text = F.when(F.col(key) == name, compile_template(source, scope, variables, filters)).otherwise(text)
    out = df.withColumn(output, text)
    return out.withColumn("needs_rerender", F.coalesce(F.col(output).rlike(r"\{\{|\{%"), F.lit(False)))
