"""Walking JSON values with native expressions.

Spark has no recursive expressions.  Where a value is rewritten from its leaves up, its JSON
text is cut into tokens and folded with a stack, so nesting has no bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import as_json, let, object_of
from .rawjson import aligned_text, pruned_text


def quoted(text: Column) -> Column:
    """A string as JSON text; only one that needs escapes goes through the JSON writer."""
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(r'["\\\x00-\x1f]'), as_json(text.cast("variant"))).otherwise(plain)


def elements_of(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "array<variant>")


def key_path(key: Column) -> Column:
    """VARIANT path of one object key, quoted so that any key can be named."""
    double = F.concat(F.lit('$["'), key, F.lit('"]'))
    return F.when(key.contains("'"), double).otherwise(F.concat(F.lit("$['"), key, F.lit("']")))


def entries_of(variant: Column) -> Column:
    """Keys and values of an object, in key order; NULL for anything else."""
    return F.map_entries(object_of(variant))


def members_of(variant: Column) -> Column:
    """Members of an array (key NULL) or an object; NULL for scalars."""
    return F.coalesce(
        F.transform(
            elements_of(variant),
            lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")),
        ),
        entries_of(variant),
    )


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# A JSON text in pieces: strings, punctuation, and the words and numbers between.
JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\[\]{}:,"\s]++'
_MEMBERS = "array<struct<key:string,value:string>>"
_FRAMES = f"array<struct<kind:string,key:string,members:{_MEMBERS}>>"


def decoded(token: Column) -> Column:
    """The content of a JSON string token."""
    inside = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(inside)


def fold_json(text: Column, scalar, container) -> Column:
    """Rewrite a JSON text from its leaves up, at any depth.

    ``scalar(token)`` gives the new text of a leaf, ``container(kind, members)`` that of an
    array ("[", keys null) or object ("{") from its members' keys and new texts.  The stack
    holds a frame for each open container, below them one for the whole value.
    """
    tokens = F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0))
    no_text = F.lit(None).cast("string")
    root = F.array(F.struct(F.lit("").alias("kind"), no_text.alias("key"), F.array().cast(_MEMBERS).alias("members"))).cast(_FRAMES)
    zero = F.struct(root.alias("frames"), no_text.alias("key"))

    def top(frames):
        return F.get(frames, F.size(frames) - 1)

    def state(frames, key=no_text):
        return F.struct(frames.alias("frames"), key.alias("key"))

    def added(frames, key, value):
        frame = top(frames)
        member = F.array(F.struct(key.alias("key"), value.alias("value")))
        grown = F.struct(frame["kind"].alias("kind"), frame["key"].alias("key"), F.concat(frame["members"], member).alias("members"))
        return F.concat(F.slice(frames, F.lit(1), F.size(frames) - 1), F.array(grown))

    def step(at, token):
        frames, key = at["frames"], at["key"]
        opened = F.struct(token.alias("kind"), key.alias("key"), F.array().cast(_MEMBERS).alias("members"))
        names = token.startswith('"') & key.isNull() & (top(frames)["kind"] == "{")
        closed = let(top(frames), lambda f: state(added(F.slice(frames, F.lit(1), F.size(frames) - 1), f["key"], container(f["kind"], f["members"]))))
        return (
            F.when(token.isin("[", "{"), state(F.concat(frames, F.array(opened))))
            .when(token.isin(",", ":"), at)
            .when(token.isin("]", "}"), closed)
            .when(names, state(frames, decoded(token)))
            .otherwise(state(added(frames, key, scalar(token))))
        )

    return F.get(F.get(F.aggregate(tokens, zero, step)["frames"], F.lit(0))["members"], F.lit(0))["value"]


def prune_json(variant: Column) -> Column:
    """JSON text with strings trimmed and empty members dropped; NULL when empty."""
    return pruned_text(as_json(variant))


def prune_json_inside(variant: Column) -> Column:
    """``prune_json`` for the elements of arrays and maps, where only native expressions can stand."""

    def scalar(token):
        content = trimmed(decoded(token))
        text = F.when(content != "", quoted(content))
        return F.when(token.startswith('"'), text).when(token != "null", token)

    def container(kind, members):
        named = F.transform(members, lambda m: F.struct(trimmed(m["key"]).alias("key"), m["value"].alias("value")))
        kept = F.filter(named, lambda m: m["value"].isNotNull() & ((m["key"] != "") | m["key"].isNull()))
        return let(kept, lambda k: F.when(F.size(k) > 0, F.when(kind == "[", array_text(k)).otherwise(object_text(k))))

    return fold_json(as_json(variant), scalar, container)


def array_text(members: Column) -> Column:
    values = F.transform(members, lambda m: m["value"])
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def object_text(entries: Column) -> Column:
    """JSON object from (key, JSON text) entries; a later duplicate key wins."""
    merged = F.map_entries(F.map_from_entries(entries))
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(merged, lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["value"])), ","),
        F.lit("}"),
    )


def restore_key_order(value: Column, original: Column) -> Column:
    """JSON text of the VARIANT ``value`` with keys ordered as in the text ``original``, at any depth.

    Keys the original lacks come last.  Lists are walked only when both sides
    have the same length and hold nothing but objects.
    """
    return aligned_text(as_json(value), original)
