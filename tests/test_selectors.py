"""Selectors: compiled predicates against a naive evaluator."""

import random
import re

import pytest

from foliospark.functions.selector import compile_selector, where
from foliospark.functions.paths import row_leaf

RANK = {"null": 0, "boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}
ABSENT = object()


def kind(v):
    if v is None:
        return "null"
    for name, types in (("boolean", bool), ("number", (int, float)), ("string", str), ("array", list), ("object", dict)):
        if isinstance(v, types):
            return name


def get(doc, dotted):
    for part in dotted.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return ABSENT
        doc = doc[part]
    return doc


def order(a, b, mongo):
    if kind(a) != kind(b):
        return None if mongo and b is not None else RANK[kind(a)] - RANK[kind(b)]
    return 0 if a == b else (-1 if a is None or a < b else 1)


def same(a, b):
    return kind(a) == kind(b) and a == b


def matches(sel, v, mongo=False):
    return all(one(k, a, v, mongo) for k, a in sel.items())


def field(v, arg, mongo):
    if isinstance(arg, dict) and arg:
        return matches(arg, v, mongo)
    return v is not ABSENT and same(v, arg)


def one(op, arg, v, mongo):
    if not op.startswith("$"):
        return field(get(v, op), arg, mongo)
    sub = lambda s: field(v, s, mongo)
    if op == "$and":
        return all(sub(s) for s in arg)
    if op == "$or":
        return any(sub(s) for s in arg)
    if op == "$nor":
        return not any(sub(s) for s in arg)
    if op == "$not":
        return not sub(arg)
    if op == "$exists":
        return (v is not ABSENT) == arg
    if op in ("$ne", "$nin"):
        hit = one("$eq" if op == "$ne" else "$in", arg, v, mongo)
        return not hit if mongo else v is not ABSENT and not hit
    if v is ABSENT:
        return False
    if op == "$eq":
        return same(v, arg)
    if op in ("$lt", "$lte", "$gt", "$gte"):
        c = order(v, arg, mongo)
        return c is not None and {"$lt": c < 0, "$lte": c <= 0, "$gt": c > 0, "$gte": c >= 0}[op]
    if op == "$in":
        return any(same(v, x) for x in arg) or (isinstance(v, list) and any(same(e, x) for e in v for x in arg))
    if op == "$type":
        return kind(v) == arg
    if op == "$size":
        return isinstance(v, list) and len(v) == arg
    if op == "$all":
        return isinstance(v, list) and all(any(same(e, x) for e in v) for x in arg)
    if op == "$elemMatch":
        return isinstance(v, list) and any(field(e, arg, mongo) for e in v)
    if op == "$allMatch":
        return isinstance(v, list) and bool(v) and all(field(e, arg, mongo) for e in v)
    if op == "$keyMapMatch":
        return isinstance(v, dict) and any(field(k, arg, mongo) for k in v)
    if op == "$mod":
        return isinstance(v, int) and not isinstance(v, bool) and int(abs(v) % abs(arg[0])) * (1 if v >= 0 else -1) == arg[1]
    if op == "$regex":
        return isinstance(v, str) and re.search(arg, v) is not None


SCALARS = [None, True, False, 0, 1, 2, -7, 2.5, "1", "ab", "b", ""]


def random_value(rng, depth=2):
    if depth and rng.random() < 0.35:
        if rng.random() < 0.5:
            return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: random_value(rng, depth - 1) for k in rng.sample(["k", "m", "n.o"], rng.randint(0, 2))}
    return rng.choice(SCALARS)


def random_condition(rng, depth=2):
    op = rng.choice(
        ["$eq", "$ne", "$lt", "$lte", "$gt", "$gte", "$in", "$nin", "$exists", "$type", "$size", "$all", "$mod", "$regex"]
        + (["$not", "$elemMatch", "$allMatch", "$keyMapMatch", "$or", "$nor"] if depth else [])
    )
    scalar = lambda: rng.choice(SCALARS)
    if op in ("$eq", "$ne"):
        return {op: random_value(rng, 1)}
    if op in ("$lt", "$lte", "$gt", "$gte"):
        return {op: scalar()}
    if op in ("$in", "$nin", "$all"):
        return {op: [scalar() for _ in range(rng.randint(1, 3))]}
    if op in ("$or", "$nor"):
        return {op: [random_condition(rng, depth - 1) for _ in range(2)]}
    fixed = {"$exists": rng.random() < 0.5, "$type": rng.choice(list(RANK)), "$size": rng.randint(0, 2), "$mod": [3, rng.choice([-1, 0, 1])], "$regex": rng.choice(["a", "^b$", "k"])}
    return {op: fixed[op] if op in fixed else random_condition(rng, depth - 1)}


@pytest.mark.parametrize("dialect", ["mango", "mongo"])
def test_random_selectors_match_naive_evaluation(docs, dialect):
    rng = random.Random(11)
    values = [{k: random_value(rng) for k in rng.sample(["a", "b", "c"], rng.randint(0, 3))} for _ in range(120)]
    df = docs(values).cache()
    leaf = row_leaf(df)
    selectors = [{rng.choice(["a", "b", "a.k"]): random_condition(rng)} for _ in range(60)]
    columns = [compile_selector(s, leaf, dialect).alias(f"s{i}") for i, s in enumerate(selectors)]
    for at in range(0, len(columns), 20):
        for row in df.select("_id", *columns[at : at + 20]).collect():
            for i, s in enumerate(selectors[at : at + 20], at):
                want = matches(s, values[int(row["_id"])], dialect == "mongo")
                assert bool(row[f"s{i}"]) == want, (s, values[int(row["_id"])])


def test_typed_comparisons_are_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 1.5D as total", "cast(id as string) as s", "'x' as unused").write.parquet(str(tmp_path / "t"))
    df = where(spark.read.parquet(str(tmp_path / "t")), {"total": {"$gt": 5}, "s": {"$in": ["7", "8"]}}).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(total,5.0)" in plan and "In(s, [7,8])" in plan and "unused" not in plan


def test_variant_paths_are_pushed_down(docs, spark, tmp_path):
    docs([{"a": i, "b": "x" * i} for i in range(50)]).write.parquet(str(tmp_path / "v"))
    df = where(spark.read.parquet(str(tmp_path / "v")), {"a": {"$gt": 40}}, "mongo").select("_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan" in plan and df.count() == 9


def test_errors(docs):
    df = docs([{"a": 1}])
    for bad in ({"a": {"$mod": [2, 0.5]}}, {"a": {"$nope": 1}}, {"a": {"$type": "date"}}, {"a": {"$regex": "(?R)"}}, {"$and": {"a": 1}}):
        with pytest.raises(ValueError):
            where(df, bad)


def test_text_searches_all_strings(docs):
    df = docs([{"t": "James Bond\nreturns"}, {"t": {"u": ["bonding"]}}, {"bond": 1}, {"x": [{"y": "BOND"}]}])
    assert [r["_id"] for r in where(df, {"$text": "bond"}).collect()] == ["0", "3"]


def test_negations_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for selector in ({"o_orderstatus": {"$not": {"$eq": "O"}}}, {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 1000}}]}):
        plan = where(orders, selector)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: []" not in plan, plan
