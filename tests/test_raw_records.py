"""Texts kept as written, schemas that refer to themselves, first errors, staged generation, ending state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import rawjson
from foliospark.functions.jsonschema import validate, validate_documents
from foliospark.operators import generation, stats, updates
from foliospark.session import scratch
from foliospark.sources import buckets, documents
from foliospark.streaming import streams


def random_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 4)
    if kind == 5:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind > 5:
        return {rng.choice(["a", "b", "é", 'q"', "x y", "]"]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([None, True, 1, 2.5, "s", "", 'a"b\\', "{[,:"])


def test_members_are_the_slices_of_a_text():
    rng = random.Random(1)
    for _ in range(500):
        value = random_value(rng)
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        kind, found = rawjson.members(text)
        if isinstance(value, dict):
            assert kind == "{" and {rawjson.name_of(k): json.loads(text[a:b]) for k, a, b in found} == value
        elif isinstance(value, list):
            assert kind == "[" and [json.loads(text[a:b]) for _, a, b in found] == value
        else:
            assert kind == "" and not found
        assert json.loads(rawjson.written(rawjson.parsed(text))) == value


def in_order(value, original):
    """The documented rule, on Python values."""
    if isinstance(value, dict) and isinstance(original, dict):
        first = {k: in_order(value[k], original[k]) for k in original if k in value}
        return first | {k: v for k, v in value.items() if k not in first}
    objects = lambda items: all(isinstance(x, dict) for x in items)
    if isinstance(value, list) and isinstance(original, list) and len(value) == len(original) and objects(value) and objects(original):
        return [in_order(v, o) for v, o in zip(value, original, strict=True)]
    return value


def test_keys_come_back_in_order_at_any_depth(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        original = random_value(rng)
        changed = json.loads(json.dumps(original, sort_keys=True))
        if isinstance(changed, dict):
            changed["new"] = 1
        pairs.append((json.dumps(changed, ensure_ascii=False), json.dumps(original, ensure_ascii=False)))
    deep = '{"z":1,"k":' * 300 + "0" + "}" * 300
    pairs.append((json.dumps(json.loads(deep), sort_keys=True), deep))
    got = spark.createDataFrame(pairs, "v string, o string").select("v", "o", rawjson.aligned_text(F.col("v"), F.col("o")).alias("out")).collect()
    for r in got:
        want = json.dumps(in_order(json.loads(r.v), json.loads(r.o)), ensure_ascii=False, separators=(",", ":"))
        assert r.out == want
    assert spark.createDataFrame([(None, "{}")], "v string, o string").select(rawjson.aligned_text(F.col("v"), F.col("o"))).first()[0] is None


def test_merge_keeps_the_text_of_what_it_does_not_change(spark):
    target = spark.createDataFrame([("1", '{ "b":1.50,  "a": {"z":1e2,"y":"\\u00e9"} , "b":2 }'), ("2", "{}"), ("3", "[1.0]"), ("4", None)], "_id string, doc string")
    changes = [("1", 1, '{"new":{"q":1.0,"p":[]},"b":3.00}'), ("1", 2, '{"b":4.00,"_id":"9"}'), ("2", 1, '{"k":null}'), ("3", 1, '{"k":1}'), ("5", 1, '{"k":1}')]
    out = updates.merge_documents(target, spark.createDataFrame(changes, "_id string, seq int, doc string"))
    got = {r._id: r.doc for r in out.collect()}
    assert got == {
        "1": '{ "b":1.50,  "a": {"z":1e2,"y":"\\u00e9"} , "b":4.00,"new":{"q":1.0,"p":[]} }',
        "2": '{"k":null}', "3": "[1.0]", "4": None,
    }


# --- schemas that refer to themselves --------------------------------------------------------

TREE = {
    "$ref": "#/definitions/node",
    "definitions": {
        "node": {
            "type": "object", "required": ["n"], "additionalProperties": False,
            "properties": {
                "n": {"type": "integer", "maximum": 8}, "kids": {"items": {"$ref": "#/definitions/node"}},
                "other": {"anyOf": [{"type": "string"}, {"$ref": "#/definitions/node"}]}, "tag": {"default": "t"},
            },
        }
    },
}


def checked(value, path=""):
    """(normalized, error) of a node of TREE."""
    loc = path or "<root>"
    if not isinstance(value, dict):
        return None, f"{loc}: value {value!r} is not of type object"
    value = value | ({} if "tag" in value else {"tag": "t"})
    if "n" not in value:
        return None, f"{loc}: missing required fields: ['n']"
    out = {}
    for key, v in value.items():
        place = f"{path}.{key}" if path else key
        if key == "n":
            if not isinstance(v, int) or isinstance(v, bool):
                return None, f"{place}: value {v!r} is not of type integer"
            if v > 8:
                return None, f"{place}: value {v} > maximum 8"
        elif key == "kids" and isinstance(v, list):
            done = [checked(x, f"{place}[{i}]") for i, x in enumerate(v)]
            bad = next((e for _, e in done if e), None)
            if bad:
                return None, bad
            v = [x for x, _ in done]
        elif key == "other" and not isinstance(v, str):
            v, bad = checked(v, place)
            if bad:
                return None, f"{place}: value did not match any schema in 'anyOf':\n  anyOf[0]: {place}: value {value[key]!r} is not of type string\n  anyOf[1]: {bad}"
        elif key not in ("kids", "other", "tag"):
            continue
        out[key] = v
    return out, None


def tree(rng, depth):
    out = {"n": rng.choice([1, 2, 3, 8] + [9] * (rng.random() < 0.1))}
    for _ in range(rng.randint(0, 2)):
        if depth:
            key = rng.choice(["kids", "other", "strange"])
            out[key] = [tree(rng, depth - 1) for _ in range(rng.randint(0, 2))] if key == "kids" else rng.choice(["s", tree(rng, depth - 1)])
    if rng.random() < 0.05:
        del out["n"]
    keys = sorted(out)  # messages print keys sorted, so records hold them so
    return {k: out[k] for k in keys}


def test_trees_are_judged_at_any_depth(spark, docs):
    rng = random.Random(4)
    values = [tree(rng, 9) for _ in range(60)] + [5, {"n": 1}, None]
    chain = {"n": 1}
    for _ in range(20):
        chain = {"kids": [chain], "n": 1}
    values += [chain, json.loads(json.dumps(chain).replace('"n": 1}]', '"n": 99}]', 1))]
    frame = docs(values).withColumn("_row", F.lit("mine")).withColumn("results", F.lit("too"))
    got = {int(r._id): r for r in validate_documents(frame, TREE, record_order=True).collect()}
    for i, value in enumerate(values):
        if value is None:
            assert got[i].error == "'data' is required in the input payload"
            continue
        want, error = checked(value)
        assert got[i].error == error
        assert got[i].normalized == (None if error else json.dumps(want, separators=(",", ":")))
        assert got[i]._row == "mine" and got[i].results == "too"
    assert validate_documents(docs([{"n": 1}]).limit(0), TREE).count() == 0
    with pytest.raises(ValueError, match="refers to itself"):
        validate(F.col("v"), TREE)


def test_self_referring_schemas_run_no_job_of_their_own(spark, docs):
    frame = docs([{"kids": [{"n": 1}, {"kids": [{"n": 99}]}], "n": 1}, {"n": 2}])
    spark.sparkContext.setJobGroup("planning", "")
    out = validate_documents(frame, TREE)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setJobGroup("other", "")


def test_an_endless_schema_is_an_error(docs):
    schema = {"properties": {"next": {"$ref": "#", "default": {}}}}
    with pytest.raises(Exception, match="leads back to itself"):
        validate_documents(docs([{"a": 1}]), schema).collect()


def test_first_error_is_the_first_in_the_record(docs):
    schema = {"properties": {"p": {"properties": {"b": {"maximum": 1}, "z": {"maximum": 1}}}, "a": {"items": {"additionalProperties": {"maximum": 1}}}}}
    texts = ['{"p":{"z":2,"b":2}}', '{"p":{"b":2,"z":2},"a":[{"y":2,"x":2}]}', '{"a":[{},{"y":2,"x":2}],"p":{"b":2}}']
    got = [r.error.split(":")[0] for r in validate_documents(docs(texts), schema).orderBy("_id").collect()]
    assert got == ["p.z", "p.b", "a[1].y"]


# --- generation, streams, ranges, counts -------------------------------------------------------


def test_a_lost_round_asks_no_stored_turn_again(spark, tmp_path):
    calls, heard, broken = (str(tmp_path / n) for n in ("calls", "heard", "broken"))
    for folder in (calls, heard):
        os.mkdir(folder)

    def note(folder, name):
        with open(f"{folder}/{name}", "a") as out:
            out.write("x")

    def ask(messages):
        turn, who = len(messages) // 2, messages[0]["content"]
        if turn == 1 and not os.path.exists(broken) and who == "u3":
            open(broken, "w").close()
            raise RuntimeError("executor lost")
        note(calls, f"{who}-{turn}")
        return {"choices": [{"message": {"role": "assistant", "content": f"{who} {turn}"}}]}

    def hook(number, result, messages):
        note(heard, f"{messages[0]['content']}-{number}")

    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("u"), "id").alias("content")))
    frame = spark.range(6).select("id", said.alias("messages"))
    store = scratch(spark, "rounds")
    with pytest.raises(Exception, match="executor lost"):
        generation.generate(frame, ask, 3, ["id"], on_iteration=hook, store=store).collect()
    rows = generation.generate(frame, ask, 3, ["id"], on_iteration=hook, store=store).collect()
    assert sorted((r.id, r.round, r.content) for r in rows) == [(i, t + 1, f"u{i} {t}") for i in range(6) for t in range(3)]
    size = lambda folder, name: os.path.getsize(f"{folder}/{name}")
    assert all(size(calls, f"u{i}-{t}") == 1 for i in range(6) for t in (0, 2))
    assert all(size(heard, f"u{i}-{t}") == 1 for i in range(6) for t in range(3))


def test_state_of_ended_iterations_is_forgotten(spark):
    source, out, mark = (scratch(spark, n) for n in ("calls", "ending", "mark"))
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
    schema = f"iteration_id bigint, call bigint, usage {usage}"
    seen = []
    for calls in ([0, 1], [2, 3]):  # the second run starts from the checkpoint of the first
        rows = [(i, c, None if c == 1 else (1, 2, 10 * c + i)) for i in range(20) for c in calls]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = streams.read_parquet_stream(spark, source, spark.createDataFrame([], schema).schema)
        query = streams.write_batches(streams.ending_iterations(stream, 4), out, mark)
        query.awaitTermination()
        seen.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    assert seen == [20, 0]
    got = {r.iteration_id: r for r in streams.ended_totals(streams.batches(spark, out)).collect()}
    assert len(got) == 20
    for i, r in got.items():
        assert (r.iterations_completed, r.total_tokens, r.last_call) == (4, 50 + 3 * i, 3)
        assert r.last_token_count.total_tokens == 30 + i


def test_compaction_bounds_the_folders_and_survives_a_crash(spark, monkeypatch):
    out = scratch(spark, "log")
    for n in range(40):
        spark.createDataFrame([(n % 5, n)], "k int, n int").write.parquet(f"{out}/batch={n}")
        if n % 10 == 9:
            streams.compact(spark, out, streams.newest_rows("k"))
    state = {r.k: r.n for r in streams.latest_state(spark, out, "k", ["n"]).collect()}
    assert state == {k: 35 + k for k in range(5)}
    assert len(streams.batch_numbers_in(spark, out)) <= 12
    before = streams.manifest(spark, out)

    def die(*_):
        raise OSError("lost")

    for n in range(40, 44):
        spark.createDataFrame([(n % 5, n)], "k int, n int").write.parquet(f"{out}/batch={n}")
    with monkeypatch.context() as patch:
        patch.setattr(streams.files, "put_new", die)
        with pytest.raises(OSError):
            streams.compact(spark, out, streams.newest_rows("k"))
    assert streams.manifest(spark, out) == before
    want = {0: 40, 1: 41, 2: 42, 3: 43, 4: 39}
    for _ in range(2):
        assert {r.k: r.n for r in streams.latest_state(spark, out, "k", ["n"]).collect()} == want
        streams.compact(spark, out, streams.newest_rows("k"))


def test_one_key_with_all_rows_is_numbered_in_ranges(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with larger ranges
    cut = stats.in_ranges(rows, ["k", "o", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 40_000 / len(sizes) * 2
    got = stats.batch_numbers(rows, ["k"], ["o", "id"], size=100).orderBy("o", "id").collect()
    assert [r.batch for r in got] == [i // 100 for i in range(40_000)] and got[0].asDict().keys() == {"k", "id", "o", "batch"}


def test_counts_of_many_collections_take_one_scan(spark):
    store = scratch(spark, "many")
    for n in ("a", "b c", "é"):
        documents.insert_docs(spark.createDataFrame([(f'{{"_id":"{i}"}}',) for i in range(3)], "doc string"), store, n)
    documents.read_collection(spark, store, "a").limit(0).write.parquet(documents.collection_path(store, "none"))
    counts = documents.collection_counts(spark, store, ["a", "b c", "é", "none", "absent", *(f"n{i}" for i in range(300))])
    assert {r["name"]: r["count"] for r in counts.collect()} == {"a": 3, "b c": 3, "é": 3, "none": 0}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_updates_do_not_shuffle_what_is_stored(spark):
    path, parts, count = scratch(spark, "laid"), 8, 16
    docs = spark.range(2_000).select(F.col("id").cast("string").alias("_id"), F.lit("1-a").alias("_rev"), F.lit('{"a":1}').alias("doc"))
    buckets.lay_out(docs, path, parts, count)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    assert len(before) == parts * count
    changes = spark.createDataFrame([("7", 1, '{"a":2}'), ("7", 2, '{"b":3}')], "_id string, seq int, doc string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = buckets.touched(spark, path, changes, parts, count)
        merged = updates.merge_documents(stored.drop("_part"), changes)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "InMemoryFileIndex(1 paths)" in plan
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line)
        deep = lambda line: len(line) - len(line.lstrip(" :+-"))
        limit = deep(lines[at])
        for line in reversed(lines[:at]):  # what the stored rows go through: only the changes are exchanged
            if deep(line) < limit:
                limit = deep(line)
                assert "Exchange" not in line, plan
        assert "Exchange" not in stored.groupBy("_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert buckets.update_laid_out(spark, path, changes, lambda s: updates.merge_documents(s, changes), parts, count) == 1
    after = files()
    assert len(before & after) == (parts - 1) * count
    got = {r._id: r.doc for r in buckets.laid_out(spark, path, parts, count).collect()}
    assert len(got) == 2_000 and got.pop("7") == '{"a":2,"b":3}' and set(got.values()) == {'{"a":1}'}
    none = changes.limit(0)
    assert buckets.update_laid_out(spark, path, none, lambda s: updates.merge_documents(s, none), parts, count) == 0
