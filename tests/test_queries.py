"""Registered queries against their SQL checks, at the smallest scale."""

import pytest

import check
from foliospark.plans import registry

SF = "/root/testdata/sf0.001"
KEYS = [
    "sel_nested", "sel_ne", "project_dotted", "key_order", "label_fallback", "src_json_docs", "sink_insert", "data_url",
    "upd_last_wins", "upd_append", "join_org", "lookup_tiers", "page_2", "agg_tokens", "win_batches", "tpl_text_form",
    "tpl_loop_prev", "build_messages", "val_oneof", "val_strip", "conf_order", "parse_configs", "env_unpack",
    "gen_rounds", "stream_iterations", "stream_upsert",
]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_query_has_a_check():
    queries, checks = registry.load_all()
    assert set(queries) == set(checks)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_sql(spark, con, name):
    registry.load_all()
    status, _, _, detail = check.compare(spark, con, name, SF)
    assert status == "ok", detail


def test_a_blank_text_is_one_empty_block(spark, tmp_path):
    """the index into a list without blocks ended the query."""
    rows = [(1, "a "), (2, ""), (3, " \n\t"), (4, "===\n==="), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.load_all()[0]["extract_blocks_fallback"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 1, "a"), (2, 1, ""), (3, 1, ""), (4, 1, "===\n==="), (5, None, None)]
