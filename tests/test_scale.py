"""What keeps the work in proportion to the rows: seen in plans and on long values."""

import json
import os
import re

from pyspark.sql import functions as F

from foliospark.functions.jsonschema import validate_documents
from foliospark.functions.jsontext import prune_json
from foliospark.functions.pytext import variant_repr
from foliospark.operators import retrieve as Q
from foliospark.operators import stats as S
from foliospark.plans import streaming as plans
from foliospark.sources import objects as O
from foliospark.streaming import streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_takes_time_in_proportion(docs):
    """one list of many numbers, whose pruned text once grew by copies of itself."""
    long = docs([{"k": [" a\\\u0001 ", "", None, *range(6000)], " ": 1}])
    out = long.select(prune_json(F.col("v")))
    assert json.loads(out.first()[0]) == {"k": ["a\\\u0001", *range(6000)]}
    assert "aggregate(" not in plan_of(out)


def test_first_document_is_found_without_sorting_all(spark, docs):
    """entries meet in a hash table a task before the shuffle."""
    found = S.infer_schema(docs([{"a": 1, "b": "x"}, {"a": "y"}]).withColumn("first", -F.length("doc")), ["first", "doc"], None)
    assert {r.field: r.type for r in found.collect()} == {"a": '{"type":"integer"}', "b": '{"type":"string"}'}
    assert "ObjectHashAggregate" in plan_of(found) and "SortAggregate" not in plan_of(found)


def test_sort_keys_are_worked_out_once(docs):
    """F8, F12: the sort compares columns, not expressions over the document."""
    found = Q.retrieve(docs([{"a": 2}, {"a": "x"}, {"a": 1}, {}]), sort={"a": 1})
    assert [r._id for r in found.collect()] == ["3", "2", "0", "1"]
    assert found.columns == ["_id", "doc", "v"]
    sort = re.search(r"Sort \[(.*)\], (true|false)", plan_of(found))[1]
    assert "(" not in sort


def test_checks_do_not_print_the_record(docs):
    """a record without errors is judged without writing it as JSON."""
    schema = {"properties": {"a": {"items": {"enum": ["N", 1]}, "maxItems": 2}, "b": {"type": "object"}}}
    out = validate_documents(docs([{"a": ["N"], "b": {}}, {"a": ["Q"]}, {"a": [1, 1.0, True]}, {"b": []}]).drop("doc"), schema)
    assert [r.error for r in out.select("_id", "error").orderBy("_id").collect()] == [
        None, "a[0]: value 'Q' not in enum ['N', 1]", "a: array has 3 items, maximum is 2", "b: value [] is not of type object",
    ]
    expressions = plan_of(out.select("error"))
    assert "to_json(v#" not in expressions and "json_object_keys" not in expressions


def test_printing_reads_members_from_the_value(docs):
    """members come from the value itself, not from its text and a path a key."""
    out = docs([{"a": ["x'", 2.5, None], "b": {"c": True}}]).select(variant_repr(F.col("v")))
    assert out.first()[0] == """{'a': ["x'", 2.5, None], 'b': {'c': True}}"""
    assert "json_object_keys" not in plan_of(out)


def test_intake_does_not_run_a_task_for_each_file(spark, tmp_path):
    """a batch's files were listed in as many tasks as there are files, and put there by one task."""
    at_once = spark.sparkContext.defaultParallelism
    names = spark.range(0, 60, 1, 1).select(F.format_string("%d.json", "id").alias("key"), F.to_json(F.struct("id")).alias("content"))
    put = O.put_objects(names, str(tmp_path / "in"))
    assert put.rdd.getNumPartitions() == at_once and put.count() == 60
    docs = streams.read_json_stream(spark, str(tmp_path / "in")).select("doc")
    stream = streams.intake(docs, str(tmp_path / "out"), str(tmp_path / "mark"))
    stream.awaitTermination()
    stored = [json.loads(r.doc)["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(stored) == list(range(60))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) >= 2 and max(s.numTasks for s in stages) <= 2 * at_once


def test_a_level_holds_little(docs):
    """every level copied the text and the name of its values, and read each of their members by itself."""
    schema = {"additionalProperties": False, "properties": {"a": {"maximum": 5}, "z": {"maximum": 5}, "next": {"$ref": "#"}, "list": {"items": {"$ref": "#"}}, "tag": {"default": 1}}}
    inner = '{"z":9,"a":9}'
    records = ['{"a":1,"next":{"list":[{"next":%s}]}}' % inner, '{"a":1,"x":2,"next":{"list":[{"z":2.0}]}}', '{"list":[{"a":9},%s],"next":%s}' % (inner, inner)]
    out = validate_documents(docs(records), schema).select("_id", "normalized", "error")
    assert [(r.normalized, r.error) for r in out.orderBy("_id").collect()] == [
        (None, "next.list[0].next.z: value 9 > maximum 5"),
        ('{"a":1,"next":{"list":[{"tag":1,"z":2}],"tag":1},"tag":1}', None),
        (None, "list[0].a: value 9 > maximum 5"),
    ]
    plan = plan_of(out)
    assert "ref, 0, key," in plan and " raw, " not in plan and " shown, " not in plan
    assert not re.search(r"try_variant_get\([^()]*, \$\['(a|z|tag)'\]", plan)


def test_no_stream_holds_all_arrived_files(spark, tmp_path, monkeypatch):
    """the driver of one stream held the name of every file that had arrived."""
    rows = [(k, f"c{k}" if k % 5 else None) for k in range(90)] + [(7, "c7")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    seen, read = [], streams.read_json_stream

    def counted(spark, path, *rest):
        seen.append(sum(f.endswith(".json") for f in os.listdir(path.removeprefix("file:"))))
        return read(spark, path, *rest)

    monkeypatch.setattr(streams, "read_json_stream", counted)
    monkeypatch.setattr(plans, "FILES_IN_FOLDER", 10, raising=False)
    found = plans.stream_json_intake(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == rows[:90]
    assert len(seen) > 8 and max(seen) < 45


def test_folders_are_taken_in_once(spark, tmp_path):
    """a second run takes in what has come since, and folders that are new."""
    name = lambda part: str(tmp_path / part)
    for lot in (range(12), range(12, 30)):
        put = spark.createDataFrame([(f"{i % 3 if lot[0] == 0 else i % 5}/{i}.json", f'{{"id":{i}}}') for i in lot], "key string, content string")
        assert O.put_objects(put, name("in")).count() == len(lot)
        streams.intake_folders(spark, name("in"), name("out"), name("mark"), at_once=2)
        assert sorted(json.loads(r.doc)["id"] for r in streams.taken_in(spark, name("out")).collect()) == list(range(lot[-1] + 1))
