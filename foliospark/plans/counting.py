"""Totals, ordered lists, ranks and schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.updates import merge_set
from ..sources.documents import collection_counts, collection_status
from .adapters import LINE_SQL, TURNS_SQL, line_doc, mixed_doc, table, turns
from .registry import query
from .storing import COUNT_SQL, TABLE_NAMES, order_updates


@query(
    "agg_tokens",
    TURNS_SQL
    + """select conv_id, cast(sum(coalesce(prompt_tokens, 0)) filter (role <> 'system') as bigint) as prompt_tokens,
                cast(sum(coalesce(completion_tokens, 0)) filter (role <> 'system') as bigint) as completion_tokens,
                cast(sum(coalesce(total_tokens, 0)) filter (role <> 'system') as bigint) as total_tokens
         from turns group by 1
         union all
         select -1, null, null, null
         """,
)
def agg_tokens(spark, sf_dir):
    """Per conversation, and for the turns without any usage: null rather than 0."""
    t = turns(spark, sf_dir)
    none = S.token_totals(t.where("role = 'system'")).select(F.lit(-1).cast("bigint").alias("conv_id"), "*")
    return S.token_totals(t, ["conv_id"]).unionByName(none)


@query("agg_counts", COUNT_SQL)
def agg_counts(spark, sf_dir):
    return collection_counts(spark, sf_dir, [f"{t}.parquet" for t in TABLE_NAMES]).withColumnRenamed("count", "n")


@query("agg_all", f"select n > 100 as big, bool_and(n > 0) as all_hold from ({COUNT_SQL}) group by 1")
def agg_all(spark, sf_dir):
    status = collection_status(spark, sf_dir, [f"{t}.parquet" for t in TABLE_NAMES])
    return S.all_hold(status.withColumn("big", F.col("documents") > 100), "status", ["big"])


@query("agg_distinct_sorted", "select distinct p_brand from part order by p_brand")
def agg_distinct_sorted(spark, sf_dir):
    return S.distinct_sorted(table(spark, sf_dir, "part"), "p_brand")


@query(
    "agg_flatten",
    LINE_SQL
    + """select _id, l_partkey, l_suppkey, cast(0 as integer) as position, 'discount' as kind, l_discount as rate from line where l_discount > 0
         union all
         select _id, l_partkey, l_suppkey, cast(case when l_discount > 0 then 1 else 0 end as integer), 'tax', l_tax from line where l_tax > 0""",
)
def agg_flatten(spark, sf_dir):
    charges = F.try_variant_get("v", "$.charges", "array<struct<kind:string,rate:double>>")
    lines = line_doc(spark, sf_dir).select("_id", "l_partkey", "l_suppkey", charges.alias("charges"))
    return S.flatten_lists(lines, "charges", ["_id", "l_partkey", "l_suppkey"]).select(
        "_id", "l_partkey", "l_suppkey", "position", "item.kind", "item.rate"
    )


@query(
    "agg_tallies",
    """select count_if(o_orderstatus in ('P', 'F')) as matched, count_if(o_orderstatus = 'P') as modified,
              count_if(o_orderstatus = 'P') as failed from orders""",
)
def agg_tallies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    results = merge_set(o, order_updates(o), "o_orderkey", ["o_orderstatus", "o_totalprice"], "seq")[1]
    return S.tallies(
        results, matched=F.col("matched_count") > 0, modified=F.col("modified_count") > 0, failed=~F.col("ok")
    )


@query(
    "infer_schema",
    """select * from (values
         ('type', '{"type":"string"}'), ('name', '{"type":"string"}'), ('nation', '{"type":"integer"}'),
         ('balance', '{"type":"number"}'), ('size', '{"type":"string"}'), ('segment', '{"type":"string"}'),
         ('note', '{"type":"null"}'), ('brand', '{"type":"string"}'), ('price', '{"type":"number"}'),
         ('active', '{"type":"boolean"}')) t(field, type)
       where (select count(*) from customer) > 0""",
)
def infer_schema(spark, sf_dir):
    """Over all documents in id order: a customer's string is the first ``size``."""
    return S.infer_schema(mixed_doc(spark, sf_dir), ["_id"], limit=None)


@query(
    "infer_schema_nested",
    """select * from (values
         ('order', '{"type":"integer"}'), ('line', '{"type":"integer"}'),
         ('flags', '{"type":"array","items":{"type":"string"}}'),
         ('charges', '{"type":"array","items":{"type":"object","properties":{"kind":{"type":"string"},"rate":{"type":"number"}}}}'),
         ('sale', '{"type":"object","properties":{"price":{"type":"number"},"qty":{"type":"integer"}}}')) t(field, type)
       where (select count(*) from lineitem where l_discount > 0) > 0""",
)
def infer_schema_nested(spark, sf_dir):
    """The document with the highest charges decides."""
    docs = line_doc(spark, sf_dir).withColumn("first", -F.length("doc"))
    return S.infer_schema(docs, ["first", "doc"], limit=None)


@query(
    "agg_messages",
    f"""select conv_id, turn // {S.SEGMENT} as segment, count(*) as n,
               string_agg(role || ': ' || text, chr(10) order by turn) as transcript
        from conversations group by 1, 2""",
)
def agg_messages(spark, sf_dir):
    docs = S.collect_messages(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"])
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return docs.select(
        "conv_id", "segment", F.size("messages").cast("bigint").alias("n"), F.array_join(line, "\n").alias("transcript")
    )


@query(
    "win_running_tokens",
    TURNS_SQL
    + """select conv_id, turn, row_number() over w as iteration, cast(sum(coalesce(total_tokens, 0)) over w as bigint) as running_total
         from turns window w as (partition by conv_id order by turn rows unbounded preceding)""",
)
def win_running_tokens(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", "turn", "usage")
    return S.running_tokens(t, "conv_id", "turn", F.col("usage.total_tokens"), chunk=4).drop("usage")


LINE_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


@query(
    "win_first_match",
    f"""select l_orderkey, l_linenumber, l_partkey, l_quantity from (
          select *, row_number() over (partition by l_orderkey order by l_suppkey, {', '.join(LINE_ORDER)}) as rn from lineitem)
        where rn = 1""",
)
def win_first_match(spark, sf_dir):
    order = ["l_suppkey"] + [c for c in LINE_ORDER if c != "l_orderkey"]
    lines = table(spark, sf_dir, "lineitem")
    return S.first_match(lines, "l_orderkey", order, ["l_linenumber", "l_partkey", "l_quantity"])


@query(
    "win_batches",
    f"""select l_suppkey, l_orderkey, l_linenumber, l_partkey,
               (row_number() over (partition by l_suppkey order by {', '.join(LINE_ORDER)}) - 1) // 100 as batch
        from lineitem""",
)
def win_batches(spark, sf_dir):
    """Batches of 100 per supplier; months of the ship date bound what one task sorts."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = S.batch_numbers(lines, ["l_suppkey"], LINE_ORDER, F.date_trunc("month", "l_shipdate"))
    return numbered.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "batch")


@query(
    "win_batches_ranged",
    f"""select l_returnflag, l_orderkey, l_linenumber, l_partkey,
               (row_number() over (partition by l_returnflag order by {', '.join(LINE_ORDER)}) - 1) // 100 as batch
        from lineitem""",
)
def win_batches_ranged(spark, sf_dir):
    """Three keys share all rows; ranges of the order bound what one task sorts."""
    numbered = S.batch_numbers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], LINE_ORDER)
    return numbered.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "batch")
