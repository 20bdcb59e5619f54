"""JSON Schema validation compiled to column expressions.

``validate`` turns one schema into one expression over a VARIANT column.  It
yields the normalized value (defaults filled, undeclared keys stripped) and the
first error with its path.  The schema is walked when the plan is built; rows are
checked natively.

A schema that refers to itself has no finite expression for one node inside another.
``validate_documents`` checks it level by level inside the record's row: the values a recurring
``$ref`` applies to make a level, those below them the next, until none is left; then the levels are
judged from the deepest up, each with the results of the one below at hand.  The plan's size
depends on the schema only, and nothing is shuffled or written.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsontext import elements_of, entries_of
from .paths import as_json, held, is_array, is_object, json_path, variant_kind, variant_literal
from .pytext import variant_number_text_of, variant_repr
from .rawjson import aligned_text, raw_entries

# Fixed value: the schema used when none is given.
PERMISSIVE = {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object"}


def parse_schema(schema):
    """A schema from an object, a JSON text or a YAML text; None stays None."""
    if schema is None or isinstance(schema, (dict, list, bool)):
        return schema
    text = str(schema).strip()
    if not text:
        return None
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        loaded = yaml.safe_load(text)
        if isinstance(loaded, (dict, list)):
            return loaded
        raise ValueError("schema is neither JSON nor a YAML object") from None


# The text of a pointer that leads elsewhere, and what ~0 and ~1 stand for.
FOREIGN_REF = "Only local $ref pointers are supported, got: {}"
POINTER_ESCAPES = {"~0": "~", "~1": "/"}


def pointer_steps(ref: str) -> list[str]:
    """The keys and positions a local JSON pointer goes through."""
    document, mark, pointer = ref.partition("#")
    first, *steps = pointer.split("/")
    if document or first or not mark:
        raise ValueError(FOREIGN_REF.format(ref))
    return [re.sub("~[01]", lambda m: POINTER_ESCAPES[m[0]], step) for step in steps]


def resolve_ref(ref: str, root):
    """What a local JSON pointer names in the schema ``root``."""
    look_up = {list: lambda items, step: items[int(step)], dict: lambda members, step: members[step]}
    return reduce(lambda found, step: look_up[type(found)](found, step), pointer_steps(ref), root)


def no_text() -> Column:
    return F.lit(None).cast("string")


#: stands in a message for a value that is printed later; a code point no text may use
VALUE_HERE = "\ufdd0"


def state(value: Column, error: Column, seen: Column | None = None) -> Column:
    """A value, its error, and the values that the error's text leaves out."""
    seen = F.lit(None).cast("array<variant>") if seen is None else seen
    return F.struct(value.alias("v"), error.alias("err"), seen.alias("seen"))


def printed(s: Column) -> Column:
    """``struct<v, err>`` with the left-out values printed into the error's text."""
    parts = F.split(s["err"], VALUE_HERE, -1)
    full = lambda part, i: F.concat(part, F.coalesce(variant_repr(F.get(s["seen"], i)), F.lit("")))
    text = F.when(s["seen"].isNull(), s["err"]).otherwise(F.array_join(F.transform(parts, full), ""))
    return F.struct(s["v"].alias("v"), text.alias("err"))


def first_of(*errors: Column | None) -> Column:
    known = [e for e in errors if e is not None]
    return F.coalesce(*known) if known else no_text()


def python_equal(v: Column, kind: Column, value) -> Column:
    """Equality as Python sees it: 1, 1.0 and true are the same."""
    number = F.try_variant_get(v, "$", "double")
    if isinstance(value, (bool, int, float)):
        return ((kind == "number") | (kind == "boolean")) & (number == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return as_json(v) == as_json(variant_literal(value))


def has_type(v: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        big = as_json(v).rlike(r"^-?\d{19,}$")
        return (kind == "number") & ((F.schema_of_variant(v) == "BIGINT") | big)
    if name in ("object", "array", "string", "boolean", "null", "number"):
        return kind == name
    return F.lit(True)


def no_variant() -> Column:
    return F.lit(None).cast("variant")


def other_entries(v: Column, declared) -> Column:
    """Entries of an object whose keys are not among ``declared``; NULL for anything else."""
    if not declared:
        return entries_of(v)
    names = F.array(*map(F.lit, declared))
    return F.filter(entries_of(v), lambda e: ~F.array_contains(names, e["key"]))


def named_members(v: Column, keys) -> Column:
    """Some members of an object as a struct, in the fields ``f0, f1, ...``; NULL for anything else."""
    asked, named = (", ".join(f"`{n}`: variant" for n in names) for names in ([k.replace("`", "``") for k in keys], [f"f{i}" for i, _ in enumerate(keys)]))
    return F.try_variant_get(v, "$", f"struct<{asked}>").cast(f"struct<{named}>")


def joined(arrays: list[Column]) -> Column:
    """One array of several, of which some may be null."""
    full = F.filter(F.array(*arrays), lambda a: a.isNotNull())
    return F.flatten(full) if len(arrays) > 1 else arrays[0]


def escaped(name):
    """A key as a part of a JSON pointer."""
    if isinstance(name, str):
        return name.replace("~", "~0").replace("/", "~1")
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def way_step(step: Column) -> tuple[Column, Column]:
    """The kind of a step of a ``Place.way``, and its key or position."""
    name = F.replace(F.replace(F.substr(step, F.lit(2)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.substring(step, 1, 1), name


def text_at(record: Column, way: Column) -> Column:
    """The text in a record that a ``Place.way`` leads to."""

    def inside(text, step):
        kind, name = way_step(step)
        item = F.get(F.from_json(text, "array<string>"), name.cast("int"))
        other = F.try_element_at(F.from_json(text, "map<string,string>"), name)
        declared = F.call_function("get_json_object", text, F.concat(F.lit("$['"), name, F.lit("']")))
        return F.when(kind == "", text).when(kind == "#", item).when(kind == "*", other).when(kind == ".", declared)

    return F.aggregate(F.split(way, "/"), record, inside)


def shown_at(way: Column) -> Column:
    """A ``Place.way`` as messages show it; NULL for the whole record."""

    def further(shown, step):
        kind, name = way_step(step)
        item = F.concat(F.coalesce(shown, F.lit("")), F.lit("["), name, F.lit("]"))
        return F.when(kind == "", shown).when(kind == "#", item).otherwise(F.concat_ws(".", shown, name))

    return F.aggregate(F.split(way, "/"), no_text(), further)


class Place(NamedTuple):
    """Where a value stands: as messages show it, as a JSON pointer from the value that is judged, its
    text in the record, and the steps to it from the record, which give its name and text where they are needed.

    A step is a slash, its kind (``.`` or ``'`` a declared key, ``*`` another, ``#`` a position) and its name.
    """

    shown: Column | None = None
    at: Column | None = None
    raw: Column | None = None
    way: Column | None = None

    def child(self, key) -> Place:
        declared = isinstance(key, str)
        column = F.lit(key) if declared else key
        # the whole record is shown as nothing, also where a level's row stands for it
        shown = column if self.shown is None else F.concat_ws(".", self.shown, column)
        at = raw = way = None
        if self.at is not None:
            at = F.concat(self.at, F.lit(f"/{escaped(key)}")) if declared else F.concat(self.at, F.lit("/"), escaped(key))
        if self.raw is not None and declared and "'" not in key:
            raw = F.get_json_object(self.raw, f"$['{key}']")
        elif self.raw is not None and not declared:
            raw = F.try_element_at(F.from_json(self.raw, "map<string,string>"), key)
        if self.way is not None:
            # no path names a key with a quote, so that its text is not known
            kind = "'" if declared and "'" in key else "."
            way = F.concat(self.way, F.lit(f"/{kind}{escaped(key)}")) if declared else F.concat(self.way, F.lit("/*"), escaped(key))
        return Place(shown, at, raw, way)

    def item(self, i: Column) -> Place:
        index = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        shown = index if self.shown is None else F.concat(F.coalesce(self.shown, F.lit("")), index)
        at = None if self.at is None else F.concat(self.at, F.lit("/"), i.cast("string"))
        raw = None if self.raw is None else F.get(F.from_json(self.raw, "array<string>"), i)
        return Place(shown, at, raw, None if self.way is None else F.concat(self.way, F.lit("/#"), i.cast("string")))


def below(schema: dict) -> list[tuple[str, object, object]]:
    """(how, key, schema) of the schemas inside a schema, in the order they are checked."""
    same = [("same", None, s) for word in ("allOf", "oneOf", "anyOf") for s in schema.get(word, [])]
    same += [("same", None, schema["not"])] if "not" in schema else []
    keys = [("key", k, s) for k, s in schema.get("properties", {}).items()]
    rest = [("rest", list(schema.get("properties", {})), schema.get("additionalProperties"))]
    return same + keys + rest + [("items", None, schema.get("items"))]


class SchemaCompiler:
    def __init__(self, root, strip_unknown: bool = True, strict_one_of: bool = False):
        self.root, self.strip, self.strict = root, strip_unknown, strict_one_of
        self.recurring = self.find_recurring()
        self.results: Column | None = None  # of the values a recurring $ref applies to, by number and pointer

    # -- references ------------------------------------------------------------
    def find_recurring(self) -> list[str]:
        """References that lead back to themselves, in order of first appearance."""
        found: list[str] = []
        done: set[str] = set()

        def walk(schema, path: tuple):
            if not isinstance(schema, dict):
                return
            ref = schema.get("$ref")
            if ref is None:
                for _, _, s in below(schema):
                    walk(s, path)
            elif ref in path:
                found.extend(r for r in path[path.index(ref) :] if r not in found)
            elif ref not in done:
                walk(resolve_ref(ref, self.root), (*path, ref))
                done.add(ref)

        walk(self.root, ())
        return found

    def reaches(self, schema, seen: tuple = ()) -> bool:
        """Whether a recurring reference can be met inside a schema."""
        if not isinstance(schema, dict):
            return False
        ref = schema.get("$ref")
        if ref is not None:
            return ref in self.recurring or ref not in seen and self.reaches(resolve_ref(ref, self.root), (*seen, ref))
        return any(self.reaches(s, seen) for _, _, s in below(schema))

    def defaults(self, schema=None, done: set | None = None) -> list:
        """The default values that can be filled in anywhere."""
        schema, done = (self.root, set()) if done is None else (schema, done)
        if not isinstance(schema, dict) or schema.get("$ref") in done:
            return []
        found = []
        if "$ref" in schema:
            done.add(schema["$ref"])
            found += self.defaults(resolve_ref(schema["$ref"], self.root), done)
        else:
            for how, _, sub in below(schema):
                found += [sub["default"]] if how == "key" and isinstance(sub, dict) and "default" in sub else []
                found += self.defaults(sub, done)
        return found

    def key(self, ref: str, place: Place) -> Column:
        return F.concat(F.lit(str(self.recurring.index(ref))), place.at)

    def targets(self, schema, v: Column, place: Place, met: set | None = None, where: tuple = ()) -> list[Column]:
        """Arrays of the values inside ``v`` that a recurring reference applies to, each named once."""
        met = set() if met is None else met
        if not self.reaches(schema):
            return []
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref not in self.recurring:
                return self.targets(resolve_ref(ref, self.root), v, place, met, where)
            if (ref, where) in met:
                return []
            met.add((ref, where))
            number = F.lit(self.recurring.index(ref)).alias("ref")
            one = F.struct(number, self.key(ref, place).alias("key"), place.way.alias("way"), v.alias("value"))
            return [F.array(one)]
        out = []
        for how, key, sub in below(schema):
            step = {"same": (), "items": (None,), "rest": (True,)}.get(how, (key,))
            if self.fresh(sub, met, (*where, *step)):
                out.append(self.targets_in(how, key, sub, v, place, met, (*where, *step)))
        return out

    def targets_in(self, how, key, sub, v: Column, place: Place, met: set, where: tuple) -> Column:
        """``targets`` of one schema inside another, as one array."""

        def inside(x: Column, at: Place) -> Column:
            return joined(self.targets(sub, x, at, met, where))

        if how == "same":
            return inside(v, place)
        if how == "key":
            default = variant_literal(sub["default"]) if "default" in sub else no_variant()
            found = F.coalesce(named_members(v, [key])["f0"], default)
            return held(found, lambda x: F.when(x.isNotNull(), inside(x, place.child(key))))
        if how == "items":
            each = F.transform(elements_of(v), lambda x, i: inside(x, place.item(i)))
        else:
            each = F.transform(other_entries(v, key), lambda e: inside(e["value"], place.child(e["key"])))
        return F.flatten(F.filter(each, lambda a: a.isNotNull()))

    def fresh(self, schema, met: set, where: tuple) -> bool:
        """Whether ``targets`` would name anything of this schema that is not named yet."""
        if not self.reaches(schema):
            return False
        ref = schema.get("$ref")
        if ref is not None:
            return (ref, where) not in met if ref in self.recurring else self.fresh(resolve_ref(ref, self.root), met, where)
        steps = {"same": (), "items": (None,), "rest": (True,)}
        return any(self.fresh(sub, met, (*where, *steps.get(how, (key,)))) for how, key, sub in below(schema))

    def recurs(self, schema) -> str | None:
        """The recurring reference that a schema is, if it is one."""
        while isinstance(schema, dict) and "$ref" in schema:
            if schema["$ref"] in self.recurring:
                return schema["$ref"]
            schema = resolve_ref(schema["$ref"], self.root)
        return None

    # -- one node ------------------------------------------------------------
    def node(self, schema, v: Column, path: Place, order: Column | None = None, intact: bool = False) -> Column:
        """``struct<v, err>`` for a present value ``v``.

        An ``intact`` value is as ``targets`` saw it, so that ``results`` tells what it holds.
        """
        if isinstance(schema, dict) and "$ref" in schema:
            ref = schema["$ref"]
            if ref not in self.recurring:
                return self.node(resolve_ref(ref, self.root), v, path, order, intact)
            if self.results is None:
                raise ValueError(f"$ref {ref} refers to itself; use validate_documents")
            changed = (lambda r: F.coalesce(r["v"], v)) if self.rewrites(schema) else lambda r: v
            return held(F.try_element_at(self.results, self.key(ref, path)), lambda r: state(changed(r), r["err"]))
        if not isinstance(schema, dict):
            if schema is False:
                return state(v, self.message(path, "schema is 'false', value not allowed"))
            return state(v, no_text())
        steps = []
        for sub in schema.get("allOf", []):
            steps.append(lambda x, sub=sub, intact=intact: self.node(sub, x, path, None, intact))
            intact = intact and not self.rewrites(sub)
        for word, pick in (("oneOf", self.one_of), ("anyOf", self.any_of)):
            if word in schema:
                steps.append(lambda x, word=word, pick=pick, intact=intact: pick(schema[word], x, path, intact))
                intact = intact and not any(map(self.rewrites, schema[word]))
        if any(k in schema for k in ("not", "const", "enum", "type")):
            steps.append(lambda x: self.plain_checks(schema, x, path, intact))
        if any(k in schema for k in ("properties", "required", "additionalProperties")):
            steps.append(lambda x: self.object(schema, x, path, order, intact))
        if any(k in schema for k in ("items", "minItems", "maxItems")):
            steps.append(lambda x: self.array(schema, x, path, intact))
        if any(k in schema for k in ("minLength", "maxLength", "minimum", "maximum")):
            steps.append(lambda x: state(x, self.bounds(schema, x, path)))
        if not steps:
            return state(v, no_text())
        out = steps[0](v)
        for step in steps[1:]:
            out = held(out, self.then(step))
        return out

    @staticmethod
    def then(step):
        """The next step, unless an error is already there."""
        return lambda s: F.when(s["err"].isNotNull(), s).otherwise(step(s["v"]))

    @staticmethod
    def message(path: Place, *parts) -> Column:
        where = F.lit("<root>") if path.shown is None else F.coalesce(path.shown, F.lit("<root>"))
        return F.concat(where, F.lit(": "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    # -- combinators ---------------------------------------------------------
    def tried(self, subs, v, path, intact) -> Column:
        """Results of all branches, in order."""
        return F.array(*[self.node(s, v, path, None, intact) for s in subs])

    def no_match(self, word, v, path, results: Column) -> Column:
        lines = F.transform(results, lambda r, i: F.concat(F.lit(f"  {word}["), i.cast("string"), F.lit("]: "), r["err"]))
        failed = F.filter(lines, lambda x: x.isNotNull())
        seen = F.flatten(F.filter(F.transform(results, lambda r: r["seen"]), lambda x: x.isNotNull()))
        return state(v, self.message(path, f"value did not match any schema in '{word}':\n", F.array_join(failed, "\n")), seen)

    def one_of(self, subs, v, path, intact) -> Column:
        def pick(results):
            matches = F.filter(results, lambda r: r["err"].isNull() & ~F.is_variant_null(r["v"]))
            found = F.get(matches, F.lit(0))
            out = F.when(F.size(matches) == 0, self.no_match("oneOf", v, path, results))
            if self.strict:
                twice = self.message(path, "matched more than one schema in 'oneOf'")
                out = out.when(F.size(matches) > 1, state(v, twice))
            return out.otherwise(found)

        return held(self.tried(subs, v, path, intact), pick)

    def any_of(self, subs, v, path, intact) -> Column:
        def pick(results):
            found = F.get(F.filter(results, lambda r: r["err"].isNull()), F.lit(0))
            nothing = found.isNull() | F.is_variant_null(found["v"])
            return F.when(nothing, self.no_match("anyOf", v, path, results)).otherwise(found)

        return held(self.tried(subs, v, path, intact), pick)

    # -- checks that never change the value -----------------------------------
    def plain_checks(self, schema, v, path, intact) -> Column:
        def failed(kind):
            tests = []
            if "const" in schema:
                wrong = f" does not equal const {schema['const']!r}"
                tests.append((~python_equal(v, kind, schema["const"]), wrong))
            if "enum" in schema:
                member = F.lit(False)
                for value in schema["enum"]:
                    member = member | python_equal(v, kind, value)
                tests.append((~member, f" not in enum {schema['enum']}"))
            if schema.get("type") is not None:
                names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
                fits = F.lit(False)
                for name in names:
                    fits = fits | has_type(v, kind, name)
                tests.append((~fits, f" is not of type {schema['type']}"))
            return F.coalesce(*[F.when(bad, why) for bad, why in tests])

        tests_of_containers = {"object": is_object, "array": is_array}
        only_type = "const" not in schema and "enum" not in schema and schema.get("type")
        out = state(v, no_text())
        if "const" in schema or "enum" in schema or schema.get("type") is not None:
            # which test fails is found here; the value is printed once, at the end
            told = lambda r: state(v, F.when(r.isNotNull(), self.message(path, "value ", VALUE_HERE, r)), F.when(r.isNotNull(), F.array(v)))
            if isinstance(only_type, str) and only_type in tests_of_containers:
                reason = F.when(~tests_of_containers[only_type](v), f" is not of type {only_type}")
            else:
                reason = held(variant_kind(v), failed)
            out = held(reason, told)
        if "not" not in schema:
            return out
        accepted = self.node(schema["not"], v, path, None, intact)["err"].isNull()
        return F.when(accepted, state(v, self.message(path, "value must not match 'not' schema"))).otherwise(out)

    def bounds(self, schema, v, path) -> Column:
        # the kind is told only of values that a cast puts out of bounds
        kind = variant_kind(v)
        size = F.length(F.try_variant_get(v, "$", "string"))
        number = F.try_variant_get(v, "$", "double")
        shown = variant_number_text_of(v)
        errors = []
        for key, bad in (("minLength", lambda n: size < n), ("maxLength", lambda n: size > n)):
            if key in schema:
                sign = "<" if key == "minLength" else ">"
                note = self.message(path, "string length ", size.cast("string"), f" {sign} {key} {schema[key]}")
                errors.append(F.when(bad(schema[key]) & (kind == "string"), note))
        for key, bad in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
            if key in schema:
                sign = "<" if key == "minimum" else ">"
                note = self.message(path, "value ", shown, f" {sign} {key} {schema[key]}")
                errors.append(F.when(bad(float(schema[key])) & (kind == "number"), note))
        return first_of(*errors)

    # -- arrays --------------------------------------------------------------
    def array(self, schema, v, path, intact) -> Column:
        arr = elements_of(v)
        n = F.size(arr)
        errors = []
        for key, sign in (("minItems", "minimum"), ("maxItems", "maximum")):
            if key in schema:
                bad = n < schema[key] if key == "minItems" else n > schema[key]
                note = self.message(path, "array has ", n.cast("string"), f" items, {sign} is {schema[key]}")
                errors.append(F.when(arr.isNotNull() & bad, note))
        count_error = first_of(*errors)
        items = schema.get("items", True)
        if not isinstance(items, dict) and items is not False:
            return state(v, count_error)

        def folded(results):
            bad = F.get(F.filter(results, lambda r: r["err"].isNotNull()), F.lit(0))
            changed = F.to_variant_object(F.transform(results, lambda r: r["v"])) if self.rewrites(items) else v
            failed = state(changed, first_of(count_error, bad["err"]), F.when(count_error.isNull(), bad["seen"]))
            return F.when(results.isNull(), state(v, no_text())).otherwise(failed)

        return held(F.transform(arr, lambda x, i: self.node(items, x, path.item(i), None, intact)), folded)

    # -- objects -------------------------------------------------------------
    def object(self, schema, v, path, order=None, intact=False) -> Column:
        properties = schema.get("properties", {})
        additional = schema.get("additionalProperties", True)
        required = schema.get("required", [])
        absent = state(F.lit(None).cast("variant"), no_text())
        defaults = [k for k, s in properties.items() if isinstance(s, dict) and "default" in s]
        # what a recurring $ref applies to is judged already, where the value is as it was then
        judged_already = {k: ref for k, s in properties.items() if intact and (ref := self.recurs(s))}
        # all members that are looked at are read at once
        read = [k for k in dict.fromkeys([*properties, *required]) if k not in judged_already]

        def member(here, key):
            found = here[f"f{read.index(key)}"]
            return F.coalesce(found, variant_literal(properties[key]["default"])) if key in defaults else found

        def result_of(key):
            return F.try_element_at(self.results, self.key(judged_already[key], path.child(key)))

        def checked(here, key):
            place = path.child(key)
            if key in judged_already:
                as_it_is = lambda: F.try_variant_get(v, json_path([key]), "variant")
                return held(result_of(key), lambda r: F.when(r.isNull(), absent).otherwise(state(F.coalesce(r["v"], as_it_is()), r["err"])))
            return held(member(here, key), lambda x: F.when(x.isNull(), absent).otherwise(self.node(properties[key], x, place, None, intact)))

        def required_error(here):
            lacks = {k: (result_of(k) if k in judged_already else member(here, k)).isNull() for k in required}
            if not lacks:
                return None
            names = F.array_join(F.array_compact(F.array(*[F.when(lack, repr(k)) for k, lack in lacks.items()])), ", ")
            return F.when(reduce(Column.__or__, lacks.values()), self.message(path, "missing required fields: [", names, "]"))

        def extra(e):
            k, x = e["key"], e["value"]
            if additional is False:
                note = self.message(path.child(k), "additional property not allowed")
                r = absent if self.strip else state(x, note)
            elif isinstance(additional, dict):
                r = self.node(additional, x, path.child(k), None, intact)
            else:
                r = state(x, no_text())
            return F.struct(k.alias("key"), r.alias("r"))

        # what is stripped leaves neither a value nor an error
        extras_matter = not (additional is False and self.strip) and (self.rewrites(schema) or additional is not True)

        def members(here):
            # declared properties, then the others
            own = [F.struct(F.lit(k).alias("key"), checked(here, k).alias("r")) for k in properties]
            parts = [F.array(*own)] if own else []
            if extras_matter or not own:
                parts.append(F.transform(other_entries(v, properties), extra))
            return parts[0] if len(parts) == 1 else F.concat(*parts)

        def folded(ms, missing):
            bad = F.filter(ms, lambda m: m["r"]["err"].isNotNull())
            keys = order if order is not None or path.raw is None else F.json_object_keys(path.raw)
            # the first failing key in the order of the record; defaults come last
            place = lambda m, ks: F.coalesce(F.nullif(F.array_position(ks, m["key"]), F.lit(0)), F.lit(1 << 30).cast("bigint"))
            at = lambda b, of: F.array_min(F.transform(b, lambda m, i: F.struct(of(m).alias("at"), i.alias("i"))))["i"]
            # the record's text is looked at only where several keys fail
            least = lambda b: at(b, lambda m: m["key"]) if keys is None else held(keys, lambda ks: at(b, lambda m: place(m, ks)))
            first = lambda b: F.get(b, F.when(F.size(b) > 1, least(b)).otherwise(0))["r"]
            return held(held(bad, first), lambda r: done(ms, r, missing))

        def done(ms, bad, missing):
            error = first_of(missing, bad["err"])
            seen = bad["seen"] if missing is None else F.when(missing.isNull(), bad["seen"])
            if not self.rewrites(schema):
                return state(v, error, seen)
            kept = F.filter(F.transform(ms, lambda m: F.struct(m["key"], m["r"]["v"])), lambda e: e["v"].isNotNull())
            # a value with an error is not looked at again
            return state(F.when(error.isNull(), F.to_variant_object(F.map_from_entries(kept))).otherwise(v), error, seen)

        def result(here):
            judged = held(members(here), lambda ms: folded(ms, required_error(here)))
            return F.when(here.isNotNull(), judged).otherwise(state(v, no_text()))

        return held(named_members(v, read), result)

    def rewrites(self, schema, seen: tuple = ()) -> bool:
        """Whether validating can change the value (so that it has to be rebuilt)."""
        if not isinstance(schema, dict):
            return False
        if "$ref" in schema:
            ref = schema["$ref"]
            return False if ref in seen else self.rewrites(resolve_ref(ref, self.root), (*seen, ref))
        if schema.get("additionalProperties") is False and self.strip:
            return True
        below = list(schema.get("properties", {}).values())
        if any(isinstance(s, dict) and "default" in s for s in below):
            return True
        for key in ("allOf", "anyOf", "oneOf"):
            below += schema.get(key, [])
        below += [schema.get("items"), schema.get("additionalProperties")]
        return any(self.rewrites(s, seen) for s in below)


def remapped(v: Column, mapping: dict[str, str]) -> Column:
    """Top-level keys of an object renamed; anything else unchanged."""
    text = as_json(v)
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    entries = F.from_json(F.when(F.substring(text, 1, 1) == "{", text), "map<string,variant>")
    renamed = F.transform_keys(entries, lambda k, _: F.coalesce(F.try_element_at(names, k), k))
    return F.coalesce(F.to_variant_object(renamed), v)


def validate(
    data: Column,
    schema=None,
    key_mapping: dict[str, str] | None = None,
    strip_unknown: bool = True,
    strict_one_of: bool = False,
    key_order: Column | None = None,
    record: Column | None = None,
) -> Column:
    """``struct<normalized, error>`` for a VARIANT column.

    ``normalized`` is JSON text, NULL on error.  ``key_order`` (the record's keys in
    their original order) makes the reported error the first one in that order; ``record`` (the
    record's JSON text) does so inside nested values too.  A schema that refers to itself needs
    ``validate_documents``.
    """
    parsed = parse_schema(schema)
    root = PERMISSIVE if parsed is None else parsed
    compiler = SchemaCompiler(root, strip_unknown, strict_one_of)
    result = judged(compiler, data, key_mapping, key_order, record)
    return held(result, lambda r: F.struct(normalized_text(r).alias("normalized"), r["error"].alias("error")))


# Fixed value: the message for a record that is not there.
DATA_REQUIRED = "'data' is required in the input payload"


def normalized_text(result: Column) -> Column:
    """JSON text of a ``judged`` record; NULL on error."""
    return F.when(result["error"].isNull(), as_json(result["v"]))


def printed_once(node: Column) -> Column:
    return held(node, printed)


def judged(compiler: SchemaCompiler, data: Column, key_mapping, key_order, record, at: Column | None = None) -> Column:
    """``struct<v, error>`` of the whole record; ``v`` is printed by ``normalized_text``, where it is asked for."""

    def checked(v):
        return held(
            printed_once(compiler.node(compiler.root, v, Place(None, at, record), key_order, compiler.results is not None)),
            lambda s: F.struct(s["v"].alias("v"), s["err"].alias("error")),
        )

    missing = data.isNull() | F.is_variant_null(data)
    working = remapped(data, key_mapping) if key_mapping else data
    required = F.struct(no_variant().alias("v"), F.lit(DATA_REQUIRED).alias("error"))
    return F.when(missing, required).otherwise(held(working, checked))


def fresh_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


NODES = "array<struct<ref:int,key:string,way:string,value:variant>>"
LEVELS = f"array<struct<nodes:{NODES},sizes:array<int>>>"
RESULTS = "array<struct<key:string,result:struct<v:variant,err:string>>>"


def running_sums(counts: Column) -> Column:
    """Sums of an array up to each position, doubling the reach from step to step."""
    reach = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(counts), F.lit(2)))).cast("int"))
    back = lambda sums, i, k: F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))
    return F.aggregate(reach, counts, lambda sums, k: F.transform(sums, lambda x, i: x + back(sums, i, k)))


def openings(text: Column) -> Column:
    """How many lists and objects a JSON text holds, or more: a bound on how deep it is nested."""
    gone = F.replace(F.replace(text, F.lit("{"), F.lit("")), F.lit("["), F.lit(""))
    return F.octet_length(text) - F.octet_length(gone)


# Fixed value: the message for a schema that leads back to itself without going into the value.
ENDLESS = "$ref leads back to itself for the same value"


def judged_by_level(compiler: SchemaCompiler, data: Column, key_mapping=None, key_order=None, record=None) -> Column:
    """``judged`` for a schema that refers to itself, level by level inside the record's row.

    Downwards, the values a recurring reference applies to make the first level, those met inside
    them the next, until none is left.  Upwards, each level is judged with the results of the one
    below at hand, a value with those found inside it alone.  A value under a recurring reference
    is judged as it stands in the record (or in a default), whatever an ``allOf`` before it may
    have filled in or stripped.
    """
    no_nodes = F.array().cast(NODES)

    def named(schema, value, place):
        found = joined(compiler.targets(schema, value, place)) if compiler.reaches(schema) else no_nodes
        return F.coalesce(found, no_nodes)

    def by_reference(number, each):
        """One expression for the schema that a value's number stands for."""
        choice = None
        for n, ref in enumerate(compiler.recurring):
            value = each(resolve_ref(ref, compiler.root))
            choice = F.when(number == n, value) if choice is None else choice.when(number == n, value)
        return choice

    def place_of(node):
        # its name and text are found where they are asked for: few records need any
        text = None if record is None else text_at(record, node["way"])
        return Place(shown_at(node["way"]), F.lit(""), text, node["way"])

    def lower(node):
        return by_reference(node["ref"], lambda s: named(s, node["value"], place_of(node)))

    def levels_of(top):
        """``top`` and the levels below it, with how many values each value of the level above holds.

        A path enters a default, and a reference at one value, once.
        """
        more = sum(1 + json.dumps(d).count("{") + json.dumps(d).count("[") for d in compiler.defaults())
        depth = (openings(as_json(data) if record is None else record) + more + 2) * len(compiler.recurring)
        zero = F.struct(F.array().cast(LEVELS).alias("levels"), top.cast(NODES).alias("nodes"), F.array(F.size(top)).cast("array<int>").alias("sizes"))
        found = lambda s: F.concat(s["levels"], F.array(F.struct(s["nodes"].alias("nodes"), s["sizes"].alias("sizes"))))
        next_ = lambda s, groups: F.struct(found(s).alias("levels"), F.flatten(groups).alias("nodes"), F.transform(groups, F.size).alias("sizes"))
        deeper = lambda s: held(F.transform(s["nodes"], lower), lambda groups: next_(s, groups))
        step = lambda s, _: F.when(F.size(s["nodes"]) == 0, s).otherwise(deeper(s))
        ended = lambda s: F.when(F.size(s["nodes"]) == 0, s["levels"]).otherwise(F.raise_error(F.lit(ENDLESS)).cast(LEVELS))
        return F.aggregate(F.sequence(F.lit(1), depth), zero, step, ended)

    def judged_level(below_, level):
        """Results of a level's values, and how many of them each group has, from those of the level below."""

        def judged_nodes(ends):
            def judged_node(node, i):
                first = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
                own = F.map_from_entries(F.slice(below_["results"], first + 1, F.get(ends, i) - first))
                return F.struct(node["key"].alias("key"), held(own, lambda known: verdict(node, known)).alias("result"))

            return F.transform(level["nodes"], judged_node)

        counts = F.coalesce(below_["sizes"], F.transform(level["nodes"], lambda _: F.lit(0)))
        ends = F.when(F.size(counts) > 1, running_sums(counts)).otherwise(counts)
        return F.struct(held(ends, judged_nodes).alias("results"), level["sizes"].alias("sizes"))

    def verdict(node, known):
        compiler.results = known
        return by_reference(node["ref"], lambda s: printed_once(compiler.node(s, node["value"], place_of(node), intact=True)))

    def results_of(top):
        none = F.struct(F.array().cast(RESULTS).alias("results"), F.lit(None).cast("array<int>").alias("sizes"))
        return F.when(F.size(top) > 0, F.map_from_entries(F.aggregate(F.reverse(levels_of(top)), none, judged_level, lambda s: s["results"])))

    def whole(known):
        compiler.results = known
        return judged(compiler, data, key_mapping, key_order, record, F.lit(""))

    working = remapped(data, key_mapping) if key_mapping else data
    present = F.when(~F.is_variant_null(working), working)
    top = held(present, lambda v: named(compiler.root, v, Place(None, F.lit(""), None, F.lit(""))))
    return held(held(top, results_of), whole)


def validation_log(
    data: Column, result: Column, schema=None, key_mapping=None, strip_unknown: bool = True
) -> Column:
    """Steps taken for a record, in order; NULL where validation failed."""
    given = parse_schema(schema) is not None
    first = "Schema parsed successfully" if given else "No schema supplied; using permissive default schema"
    second = F.lit("[2/4] No key_mapping applied")
    if key_mapping:
        changed = as_json(remapped(data, key_mapping)) != as_json(data)
        applied = F.when(changed, f"[2/4] Applied key_mapping: {key_mapping}")
        is_object = F.substring(as_json(data), 1, 1) == "{"
        second = F.when(is_object, applied).otherwise(second)
    steps = F.array(
        F.lit(f"[1/4] {first}"),
        second,
        F.lit(f"[3/4] Validating data against schema (strip_unknown={strip_unknown})"),
        F.lit("[4/4] Validation complete"),
    )
    return F.when(result["error"].isNull(), F.array_compact(steps))


def renamed_keys(text: Column, mapping: dict[str, str]) -> Column:
    """An object's text with its outermost keys renamed and nothing else changed."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    entry = lambda e: F.concat(as_json(F.coalesce(F.try_element_at(names, e["key"]), e["key"]).cast("variant")), F.lit(":"), e["value"])
    put = F.concat(F.lit("{"), F.array_join(F.transform(raw_entries(text), entry), ","), F.lit("}"))
    return F.coalesce(put, text)


POLICIES = ("passthrough", "none", "raise")


def apply_policy(result: Column, original: Column, policy: str = "passthrough", cover_reported: bool = False) -> Column:
    """What a record becomes: normalized, or on error what the policy says.

    A reported validation error yields NULL even under ``passthrough``, unless
    ``cover_reported`` extends the policy to it; ``raise`` then fails the job.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if not cover_reported or policy == "none":
        return result["normalized"]
    if policy == "passthrough":
        return F.when(result["error"].isNotNull(), original).otherwise(result["normalized"])
    return F.when(result["error"].isNotNull(), F.raise_error(result["error"])).otherwise(result["normalized"])


def validate_documents(
    df: DataFrame,
    schema=None,
    column: str = "v",
    verbose: bool = False,
    record_order: bool = False,
    key_mapping: dict[str, str] | None = None,
    strip_unknown: bool = True,
    strict_one_of: bool = False,
    key_order: Column | None = None,
) -> DataFrame:
    """Add ``normalized``, ``error`` and, when verbose, ``log``.

    Where ``df`` has the text ``doc``, the error reported is the first in the record's order, at any depth.
    With ``record_order``, ``normalized`` has the record's keys in the record's order, its numbers and
    strings as they are written there; filled-in defaults come last.
    """
    record = None
    if "doc" in df.columns and key_order is None:
        record = F.col("doc")
        key_order = F.json_object_keys("doc")
        if key_mapping:
            names = F.create_map(*[F.lit(x) for pair in key_mapping.items() for x in pair])
            key_order = F.transform(key_order, lambda k: F.coalesce(F.try_element_at(names, k), k))
            record = None
    parsed = parse_schema(schema)
    compiler = SchemaCompiler(PERMISSIVE if parsed is None else parsed, strip_unknown, strict_one_of)
    found = fresh_name(df, "_result")
    if compiler.recurring:
        out = df.withColumn(found, judged_by_level(compiler, F.col(column), key_mapping, key_order, record))
    else:
        out = df.withColumn(found, judged(compiler, F.col(column), key_mapping, key_order, record))
    if verbose:
        log = validation_log(F.col(column), F.col(found), schema, key_mapping, strip_unknown)
        out = out.withColumn("log", log)
    normalized = normalized_text(F.col(found))
    if record_order:
        original = F.col("doc") if "doc" in df.columns else as_json(F.col(column))
        if key_mapping:
            original = renamed_keys(original, key_mapping)
        normalized = aligned_text(normalized, original, spelling=True)
    return out.withColumns({"normalized": normalized, "error": F.col(f"{found}.error")}).drop(found)
