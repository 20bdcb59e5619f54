"""Sorting and paging, running windows under skew, blocks, validation, conforming."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import blocks as Y
from foliospark.functions.jsonschema import parse_schema, resolve_ref, validate_documents
from foliospark.functions.jsontext import restore_key_order
from foliospark.operators import conform as C
from foliospark.operators import generation as G
from foliospark.operators import reshape as R
from foliospark.operators import retrieve as Q
from foliospark.operators import stats as S


def test_sort_specs():
    assert Q.normalize_sort({"a": "DESC", "b": 1, "c": -1}) == [("a", -1), ("b", 1), ("c", -1)]
    assert Q.normalize_sort(["a", {"b": "descending"}, {"c": -1}, {"x": 1, "y": 1}, 3]) == [("a", 1), ("b", -1), ("c", -1)]
    assert Q.normalize_sort(None) == [] and Q.normalize_sort([]) == []
    with pytest.raises(ValueError):
        Q.normalize_sort("a")


def test_pages_cover_everything_in_order(spark):
    df = spark.range(97).selectExpr("cast(id as string) as _id", "if(id % 5 = 0, null, id % 7) as g", "id % 3 as h").cache()
    sort = [{"g": "desc"}, "h"]
    want = [r["_id"] for r in Q.retrieve(df, sort=sort, limit=None).collect()]
    got, mark = [], None
    while True:
        page = Q.retrieve(df, sort=sort, limit=20, bookmark=mark)
        rows = [r["_id"] for r in page.collect()]
        got += rows
        if len(rows) < 20:
            break
        mark = Q.bookmark_of(df, sort, "_id", page)
    assert got == want and len(got) == 97


def test_top_k_is_not_a_full_sort(spark):
    plan = Q.retrieve(spark.range(100).withColumnRenamed("id", "_id"), sort={"_id": -1}, limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_running_values_with_one_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) as k", "id as pos", "id % 11 as x")
    out = S.chunked_running(df, ["k"], ["pos"], F.floor(F.col("pos") / 100), {"rn": F.lit(1), "total": F.col("x")})
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        n, t = seen.get(r["k"], (0, 0))
        seen[r["k"]] = (n + 1, t + r["x"])
        assert (r["rn"], r["total"]) == seen[r["k"]]


def test_long_conversations_come_in_segments(spark):
    rows = spark.range(1000).selectExpr("7 as conv", "id as turn", "'user' as role", "cast(id as string) as text")
    docs = S.collect_messages(rows, "conv", ["turn"], ["role", "text"], segment=256).orderBy("segment").collect()
    assert [len(d["messages"]) for d in docs] == [256, 256, 256, 232]
    assert [m["text"] for d in docs for m in d["messages"]] == [str(i) for i in range(1000)]


def test_token_totals(spark):
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
    df = spark.createDataFrame([(1, (3, None, 3)), (1, None), (2, (None, None, None)), (2, None)], f"k int, usage {usage}")
    rows = {r["k"]: (r["prompt_tokens"], r["completion_tokens"]) for r in S.token_totals(df, ["k"]).collect()}
    assert rows == {1: (3, 0), 2: (None, None)}


def test_schema_inference_takes_the_first_document(docs):
    df = docs([{"a": 1.0, "b": [{"c": True}], "e": []}, {"a": "x", "d": None}])
    got = {r["field"]: json.loads(r["type"]) for r in S.infer_schema(df, ["_id"], limit=2).collect()}
    assert got["a"] == {"type": "number"} and got["d"] == {"type": "null"} and got["e"] == {"type": "array", "items": {}}
    assert got["b"] == {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "boolean"}}}}
    assert "d" not in {r["field"] for r in S.infer_schema(df, ["_id"], limit=1).collect()}


def test_blocks(spark):
    texts = ["---\na: 1\n---", "a: 1\n  ----- \nb: 2", "  plain  ", "", "a--- b", "---\n---"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(Y.extract_blocks(F.col("t"), fallback_to_full=False), Y.extract_blocks(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a: 1"], ["a: 1", "b: 2"], [], [], [], []]
    assert [r[1] for r in rows] == [["a: 1"], ["a: 1", "b: 2"], ["plain"], [], ["a--- b"], ["---\n---"]]


def test_flat_blocks_read_like_yaml(spark):
    yaml = pytest.importorskip("yaml")
    texts = ["a: 1", "a: yes", "a: x\nb: -2.5", "a: 007", "a: 1e3", "no: a", "a: b c", "a: 'q'", "a: x\na: y", "k: true", "k: ~", "k: 2020-01-01", "x y: z", "k: 1_000", "k: x#y", "k: nan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", Y.flat_json(F.col("t")).alias("j")).collect():
        if r["j"] is not None:
            assert json.loads(r["j"]) == yaml.safe_load(r["t"]), r["t"]
    got = Y.parse_configs(df, "t", ["t"]).collect()
    assert {r["t"]: json.loads(r["config"]) for r in got} == {
        t: json.loads(json.dumps(yaml.safe_load(t), default=str)) for t in texts
    }


def test_validation_messages(docs):
    df = docs([{"n": True}, {"n": 1.5, "x": 1}, {"n": 3, "t": {"r": {"r": {"n": "s"}}}}, [1], {"n": 2}])
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "default": 0}, "t": {"properties": {"r": {"$ref": "#"}}}}, "additionalProperties": False}
    rows = validate_documents(df, schema).orderBy("_id").collect()
    assert rows[0]["error"] == "n: value True is not of type integer"
    assert rows[1]["error"] == "n: value 1.5 is not of type integer"
    assert rows[2]["error"] is None and json.loads(rows[2]["normalized"]) == {"n": 3, "t": {"r": {"n": 0}}}
    assert rows[3]["error"] == "<root>: value [1] is not of type object"
    assert rows[4]["normalized"] == '{"n":2}'


def test_schema_texts_and_refs():
    assert parse_schema('{"type": "object"}') == parse_schema("type: object") == {"type": "object"}
    assert resolve_ref("#/a~1b/1/c~0d", {"a/b": [0, {"c~d": 5}]}) == 5
    with pytest.raises(ValueError):
        resolve_ref("http://x", {})


def test_key_order_is_restored_at_every_level(spark):
    original = '{"z":1,"l":[{"y":1,"a":2}],"b":{"q":1,"c":{"n":1,"m":2}}}'
    df = spark.createDataFrame([(original,)], "o string")
    out = df.select(restore_key_order(F.parse_json(F.concat(F.lit('{"new":0,'), F.substring("o", 2, 999))), F.col("o"))).first()[0]
    assert out == original[:-1] + ',"new":0}'


def test_prune_keeps_zero_and_false(docs):
    df = docs([{"a": 0, "b": False, "c": " ", "d": [None, "", {"e": []}], " f ": " x "}, {"a": [""]}])
    rows = [r[0] for r in df.orderBy("_id").select(F.to_json(R.prune_empty(F.col("v"), df.schema["v"].dataType))).collect()]
    assert rows == ['{"a":0,"b":false,"f":"x"}', None]


def test_template_columns():
    t = {"org_context": {"m": [{"a": "string", "b": 1, "c": 2.5, "d": True}], "l": ["x"], "o": {"oneOf": [{"type": "array", "items": "integer"}, {"type": "object"}]}}}
    names = lambda key, v=0: [(f.name, f.dataType.simpleString()) for f in R.columns_from_template(t, target_key=key, variant=v)]
    assert names("m") == [("a", "string"), ("b", "bigint"), ("c", "double"), ("d", "boolean")]
    assert names("l") == [("value", "string")] and names("none") == []
    assert names("o") == [("value", "bigint")] and names("o", 9) == [("key", "string"), ("value", "string")]


def test_hints(spark):
    doc = '{"a":"12","b":true,"c":{"x":1},"d":null,"e":3,"f":"x"}'
    hints = {"a": "int", "b": "str", "c": "str", "d": "list", "e": "float", "f": "int"}
    spec = C.Spec(("a", "b", "c", "d", "e", "f"))
    out = spark.createDataFrame([(doc,)], "doc string").select(C.conform(F.col("doc"), spec, hints)).first()[0]
    assert json.loads(out) == {"a": 12, "b": True, "c": "{'x': 1}", "d": [None], "e": 3.0, "f": "x"}


def test_generation_stops(spark):
    df = spark.createDataFrame([(1, [("user", "go")])], "k int, messages array<struct<role:string,content:string>>")
    replies = lambda m: {"choices": [{"message": {"role": "assistant", "content": str(len(m))}}]} if len(m) < 4 else None
    rows = G.generate(df, replies, 5, ["k"]).orderBy("round").collect()
    assert [r["content"] for r in rows] == ["1", "3"]


def test_small_dimensions_do_not_shuffle_documents(spark, monkeypatch):
    from foliospark.operators import lookup as L

    docs = spark.range(1000).selectExpr("id", "concat('set', id % 5) as name")
    sets = spark.createDataFrame([(f"{i}", f"set{i}", f"p{i}") for i in range(4)], "_id string, parameter_set_name string, parameters string")
    small = L.lookup_parameters(docs, sets, "name")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(L, "BROADCAST_ROWS", 1)
    salted = L.lookup_parameters(docs, sets, "name")
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))


def test_blank_rows_data_urls_and_message_lists(spark, tmp_path):
    from foliospark.operators.messages import rendered_messages
    from foliospark.operators.reshape import typed_rows
    from foliospark.sources.objects import read_data_urls

    assert [tuple(r) for r in typed_rows(spark, 2, {"a": "int", "b": "bool", "c": "str"}, "-").collect()] == [(0, False, "-")] * 2
    assert typed_rows(spark, 0, ["a"]).count() == 0
    (tmp_path / "x.txt").write_bytes(b"hi")
    assert [r.data_url for r in read_data_urls(spark, str(tmp_path)).collect()] == ["data:text/plain;base64,aGk="]
    people = spark.createDataFrame([("Ada",)], "name string")
    starter = [{"role": "system", "content": "Hi {{ name }}"}, {"role": "user", "content": [{"type": "text", "text": "{{ name }}?"}]}]
    got = people.select(F.to_json(rendered_messages(people, starter)).alias("m")).first()["m"]
    assert json.loads(got) == [{"role": "system", "content": "Hi Ada"}, {"role": "user", "content": [{"type": "text", "text": "Ada?"}]}]
