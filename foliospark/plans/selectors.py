"""Selector queries, one per operator of the selector language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.selector import where
from ..operators.views import create_partial_view, in_partition, write_partitioned
from ..session import scratch
from .adapters import LINE_SQL, MIXED_SQL, event_doc, line_doc, mixed_doc, table
from .registry import query

O = ["o_orderkey", "o_orderstatus", "o_totalprice"]
O_SQL = "select o_orderkey, o_orderstatus, o_totalprice from orders where "


def orders_query(name, selector, condition, dialect="mango"):
    @query(name, O_SQL + condition)
    def run(spark, sf_dir):
        return where(table(spark, sf_dir, "orders"), selector, dialect).select(*O)


def mixed_query(name, selector, condition, dialect="mango"):
    @query(name, MIXED_SQL + "select _id from mixed where " + condition)
    def run(spark, sf_dir):
        return where(mixed_doc(spark, sf_dir), selector, dialect).select("_id")


def line_query(name, selector, condition):
    @query(name, LINE_SQL + "select _id, l_partkey, l_suppkey from line where " + condition)
    def run(spark, sf_dir):
        return where(line_doc(spark, sf_dir), selector).select("_id", "l_partkey", "l_suppkey")


orders_query("sel_implicit_eq", {"o_orderstatus": "O"}, "o_orderstatus = 'O'")
orders_query(
    "sel_implicit_and",
    {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"},
    "o_orderstatus = 'O' and o_orderpriority = '1-URGENT'",
)
orders_query("sel_lt", {"o_totalprice": {"$lt": 120000}}, "o_totalprice < 120000")
orders_query(
    "sel_lte", {"o_orderdate": {"$lte": "1996-06-30"}}, "o_orderdate <= timestamp '1996-06-30 00:00:00'"
)
orders_query("sel_gte", {"o_totalprice": {"$gte": 250000.5}}, "o_totalprice >= 250000.5")
orders_query("sel_gt", {"o_totalprice": {"$gt": 300000}}, "o_totalprice > 300000")
orders_query("sel_nin", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus not in ('F', 'P')")
orders_query(
    "sel_mod", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3"
)
orders_query(
    "sel_and",
    {"$and": [{"o_totalprice": {"$gt": 100000}}, {"o_orderstatus": {"$in": ["O", "P"]}}]},
    "o_totalprice > 100000 and o_orderstatus in ('O', 'P')",
)
orders_query(
    "sel_or",
    {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 50000}}]},
    "o_orderstatus = 'P' or o_totalprice < 50000",
)
orders_query(
    "sel_nor",
    {
        "o_totalprice": {"$gte": 50000, "$lte": 250000},
        "$nor": [{"o_orderstatus": "F"}, {"o_orderpriority": "5-LOW"}],
    },
    "o_totalprice between 50000 and 250000 and not (o_orderstatus = 'F' or o_orderpriority = '5-LOW')",
)

mixed_query(
    "sel_ne",
    {"size": {"$ne": 10}},
    "size_str is not null or (size_num is not null and size_num <> 10)",
)
mixed_query(
    "sel_ne_absent",
    {"size": {"$ne": 10}},
    "size_num is null or size_num <> 10",
    dialect="mongo",
)
mixed_query("sel_gt_null", {"note": {"$gte": None}, "_id": {"$gt": None}}, "has_note")
mixed_query(
    "sel_gt_ranked",
    {"size": {"$gt": 25}},
    "size_num > 25 or size_str is not null",
)
mixed_query("sel_lt_same_kind", {"size": {"$lt": "3"}}, "size_str < '3'", dialect="mongo")
mixed_query("sel_exists", {"note": {"$exists": True}}, "has_note")
mixed_query(
    "sel_not_exists", {"size": {"$exists": False}}, "size_str is null and size_num is null"
)
mixed_query("sel_type", {"size": {"$type": "string"}}, "size_str is not null")
mixed_query(
    "sel_type_null", {"$or": [{"note": {"$type": "null"}}, {"active": {"$type": "boolean"}}]},
    "has_note or active is not null",
)
mixed_query("sel_not", {"$not": {"size": {"$gte": 20}}, "type": {"$ne": "customer"}},
            "type <> 'customer' and (size_num is null or size_num < 20)")
mixed_query(
    "sel_regex", {"name": {"$regex": "r#0{6,}[0-4]"}}, "regexp_matches(name, 'r#0{6,}[0-4]')"
)
mixed_query(
    "sel_in_numbers", {"size": {"$in": [1, 2, "4", 40.0]}}, "size_num in (1, 2, 40) or size_str = '4'"
)
mixed_query("sel_mod_number", {"size": {"$mod": [5, 2]}}, "size_num % 5 = 2")

line_query("sel_eq", {"sale.qty": {"$eq": 17}}, "qty = 17")
line_query("sel_eq_deep", {"flags": {"$eq": ["A", "F"]}}, "l_returnflag = 'A' and l_linestatus = 'F'")
line_query(
    "sel_eq_object",
    {"charges": [{"kind": "tax", "rate": 0.05}]},
    "l_discount = 0 and l_tax = 0.05",
)
line_query(
    "sel_in", {"line": {"$in": [1, 3, 5]}}, "l_linenumber in (1, 3, 5)"
)
line_query("sel_in_array", {"flags": {"$in": ["N", "R"]}}, "l_returnflag in ('N', 'R')")
line_query("sel_size", {"charges": {"$size": 1}}, "n_charges = 1")
line_query("sel_all", {"flags": {"$all": ["O", "N"]}}, "l_returnflag = 'N' and l_linestatus = 'O'")
line_query(
    "sel_elem_match",
    {"charges": {"$elemMatch": {"kind": "tax", "rate": {"$gt": 0.05}}}},
    "l_tax > 0.05",
)
line_query(
    "sel_all_match",
    {"charges": {"$allMatch": {"rate": {"$lte": 0.05}}}},
    "n_charges > 0 and l_discount <= 0.05 and l_tax <= 0.05",
)
line_query(
    "sel_nested",
    {
        "$or": [
            {"flags": {"$not": {"$elemMatch": {"$in": ["N", "R"]}}}},
            {"$and": [{"sale": {"qty": {"$gt": 20, "$lt": 30}}}, {"$nor": [{"line": 1}]}]},
        ]
    },
    "l_returnflag not in ('N', 'R') or (qty > 20 and qty < 30 and l_linenumber <> 1)",
)


@query(
    "sel_subfield",
    "select event_id from events where cast(regexp_extract(props, '[0-9]+') as integer) = 42",
)
def sel_subfield(spark, sf_dir):
    found = where(event_doc(spark, sf_dir), {"props": {"k": 42}})
    return found.select(F.col("_id").cast("bigint").alias("event_id"))


@query(
    "sel_key_map",
    "select event_id from events where regexp_matches(props, '\"k') and event_type = 'view'",
)
def sel_key_map(spark, sf_dir):
    selector = {"props": {"$keyMapMatch": {"$regex": "^k"}}, "event_type": "view"}
    return where(event_doc(spark, sf_dir), selector).select(
        F.col("_id").cast("bigint").alias("event_id")
    )


@query(
    "sel_text",
    r"""select doc_id, lang from documents
        where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|und|por)($|[^\p{L}\p{N}_])')""",
)
def sel_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return where(docs, {"$text": "The und POR"}, text_columns=["text"]).select("doc_id", "lang")


EXACT_SQL = """select o_orderkey from (select *, 9007199254740992 + o_orderkey as big from orders) where """


def exact_docs(spark, sf_dir):
    """Orders with keys that doubles cannot tell from their neighbours."""
    big = F.lit(1 << 53).cast("bigint") + F.col("o_orderkey")
    doc = F.parse_json(F.concat(F.lit('{"n":'), big, F.lit("}")))
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("v"))


@query("sel_exact_eq", EXACT_SQL + "big = 9007199254740992 + 33")
def sel_exact_eq(spark, sf_dir):
    return where(exact_docs(spark, sf_dir), {"n": (1 << 53) + 33}).select("o_orderkey")


@query("sel_exact_range", EXACT_SQL + "big > 9007199254740992 + 33 and big <= 9007199254740992 + 101 and big not in (9007199254740992 + 35)")
def sel_exact_range(spark, sf_dir):
    wanted = {"n": {"$gt": (1 << 53) + 33, "$lte": (1 << 53) + 101, "$nin": [(1 << 53) + 35, 7]}}
    return where(exact_docs(spark, sf_dir), wanted).select("o_orderkey")


@query(
    "sel_partition",
    "select doc_id, n_chars from documents where lang = 'de' and n_chars >= 500",
)
def sel_partition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    path = write_partitioned(docs, "lang", scratch(spark, "partitioned"))
    stored = in_partition(spark, path, "lang", "de", docs.schema)
    return where(stored, {"n_chars": {"$gte": 500}}).select("doc_id", "n_chars")


@query(
    "sel_partial_view",
    O_SQL + "o_orderstatus = 'O' and o_totalprice > 200000",
)
def sel_partial_view(spark, sf_dir):
    view = create_partial_view(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, "open_orders")
    return where(view, {"o_totalprice": {"$gt": 200000}}).select(*O)
