"""Sources, sinks and updates on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import updates as U
from foliospark.sources import documents as D
from foliospark.sources import objects as B


def test_json_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": 1,\n "x": 2\n}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c_corrupted.json").write_text("{}")
    (tmp_path / "d.txt").write_text("{}")
    docs, rejects = D.read_json_documents(spark, str(tmp_path))
    assert [json.loads(r["doc"])["x"] for r in docs.collect()] == [2]
    assert docs.select(F.try_variant_get("v", "$.x", "int")).first()[0] == 2  # the last duplicate wins
    assert [r["file"].rsplit("/", 1)[1] for r in rejects.collect()] == ["b.json"]
    assert D.read_json_documents(spark, str(tmp_path), False)[0].count() == 2
    with pytest.raises(FileNotFoundError):
        D.read_json_documents(spark, str(tmp_path / "none"))


def test_folder_tree(spark, tmp_path):
    for name in ("ORG_CONTEXT", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text('{"a": 1}')
    rows = D.read_folder_tree(spark, str(tmp_path)).collect()
    assert [r["collection"] for r in rows] == ["org_context"]
    with pytest.raises(FileNotFoundError):
        D.read_folder_tree(spark, str(tmp_path / "none"))


def test_insert_refuses_taken_and_repeated_ids(spark, docs, tmp_path):
    store = str(tmp_path)
    first = spark.createDataFrame([("a", '{"n":1}'), ("a", '{"n":2}'), ("b", '{"n":3}')], "_id string, doc string")
    accepted, rejects = D.insert_docs(first, store, "c")
    assert accepted.count() == 2 and rejects.collect()[0]["reason"] == "repeated in input"
    _, rejects = D.insert_docs(first, store, "c")
    assert {r["_id"]: r["rejected"] for r in rejects.collect()} == {"a": 2, "b": 1}
    assert D.read_collection(spark, store, "c").count() == 2
    with pytest.raises(ValueError):
        D.insert_docs(first.where("false"), store, "c")
    with pytest.raises(ValueError):
        D.purge(spark, store, "c", reupload=True)
    removed = D.purge(spark, store, ["c", "none"]).collect()
    assert {r["name"]: r["removed"] for r in removed} == {"c": 2, "none": 0}
    status = {r["name"]: (r["status"], r["documents"]) for r in D.collection_status(spark, store, ["c", "none"]).collect()}
    assert status == {"c": (True, 0), "none": (False, 0)}


def test_generated_ids(spark):
    rows = D.assign_ids(spark.range(50)).collect()
    assert len({r["_id"] for r in rows}) == 50


def test_set_can_write_null(spark):
    target = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, d double")
    updates = spark.createDataFrame([(1, None, True, 1), (9, "z", True, 1)], "k int, s string, has_s boolean, seq int")
    state, results = U.merge_set(target, updates, "k", ["s"], "seq")
    assert {r["k"]: r["s"] for r in state.collect()} == {1: None, 2: "y"}
    assert {r["k"]: (r["matched_count"], r["modified_count"], r["ok"]) for r in results.collect()} == {1: (1, 1, True), 9: (0, 0, False)}


def test_second_update_of_one_revision_conflicts(spark):
    target = spark.createDataFrame([("a", "1-x", "{}")], "_id string, _rev string, doc string")
    updates = spark.createDataFrame([("a", "1-x", '{"n":1}', 1), ("a", "1-x", '{"n":2}', 2), ("b", "1-x", "{}", 3)], "_id string, _rev string, doc string, seq int")
    state, accepted, conflicts = U.replace_with_rev(target, updates, "seq")
    assert state.first()["doc"] == '{"n":1}' and accepted.first()["_rev"].startswith("2-")
    assert sorted(r["reason"] for r in conflicts.collect()) == ["repeated update", "unknown id"]


def test_copy_of_one_object(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(bytes(range(256)) * 100)
    plan = B.plan_copy(B.list_objects(spark, str(tmp_path)), "/in/", "out", objects=["f.bin", "gone"])
    tally = B.copy_tally(B.copy_objects(plan, str(tmp_path), str(tmp_path)).cache()).first()
    assert (tally["total_processed"], tally["successful_count"], tally["status"]) == (2, 1, "success")
    assert (tmp_path / "out" / "f.bin").read_bytes() == (tmp_path / "in" / "f.bin").read_bytes()
