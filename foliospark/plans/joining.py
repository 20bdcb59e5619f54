"""Lookups, sets, sorting and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import retrieve as Q
from ..operators.updates import unknown_ids
from .adapters import CONTEXT_SQL, MIXED_SQL, mixed_doc, table
from ..session import scratch
from .registry import query

# Dimension rows; names repeat on purpose, and some wanted names are missing.
PARAMETER_ROWS = [
    ("p3", "set1", '{"temperature":0.9}'),
    ("p1", "set0", '{"temperature":0.1}'),
    ("p2", "set1", '{"temperature":0.5}'),
    ("p4", "set2", None),
]
TEMPLATE_ROWS = [
    ("t1", "user", '{"system_prompt":"Answer."}'),
    ("t2", "assistant", '{"system_prompt":"Continue."}'),
    ("t3", "user", '{"system_prompt":"Never used."}'),
]


def parameters(spark):
    return spark.createDataFrame(PARAMETER_ROWS, "_id string, parameter_set_name string, parameters string")


def templates(spark):
    return spark.createDataFrame(TEMPLATE_ROWS, "_id string, name string, system_templates string")


@query(
    "join_params",
    """select conv_id, turn, 'set' || conv_id % 4 as parameter_set_name,
              case conv_id % 4 when 0 then '{"temperature":0.1}' when 1 then '{"temperature":0.5}'
                               when 2 then null else '{"temperature":1.0}' end as parameters
       from conversations""",
)
def join_params(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.format_string("set%d", F.col("conv_id") % 4).alias("parameter_set_name")
    )
    return L.lookup_parameters(c, parameters(spark), default=F.lit('{"temperature":1.0}'))


@query(
    "join_templates",
    """select conv_id, turn, case role when 'user' then '{"system_prompt":"Answer."}'
              when 'assistant' then '{"system_prompt":"Continue."}' else '{}' end as system_templates
       from conversations""",
)
def join_templates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("system_template_name"))
    return L.lookup_templates(c, templates(spark)).drop("system_template_name")


def organisations(spark, sf_dir):
    """Nations as organisations; the first region's have no language, the last one's are missing."""
    n = table(spark, sf_dir, "nation").where(F.col("n_regionkey") < 4)
    return n.select(
        F.col("n_name").alias("_id"),
        F.col("n_nationkey").alias("org_id"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("L"), F.col("n_regionkey"))).alias("language"),
        F.to_json(F.struct(F.col("n_name").alias("client_name"))).alias("org_context"),
    )


@query(
    "join_org",
    """select c_custkey, c_nationkey as org_id,
              case when n_regionkey between 1 and 3 then 'L' || n_regionkey else 'English' end as language,
              case when n_regionkey < 4 then '{"client_name":"' || n_name || '"}' else '{}' end as org_context
       from customer join nation on c_nationkey = n_nationkey""",
)
def join_org(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("org_id"))
    return L.lookup_organisation(c, organisations(spark, sf_dir))


@query(
    "assemble_context",
    """select c_custkey, c_nationkey as org_id, 'set' || c_custkey % 4 as parameter_set_name,
              c_mktsegment as template_name,
              case c_custkey % 4 when 0 then '{"temperature":0.1}' when 1 then '{"temperature":0.5}' end as parameters,
              case when c_acctbal > 0 then c_name when n_regionkey < 4 then n_name else 'seg ' || c_mktsegment end as title,
              case when n_regionkey < 4 then n_name end as client_name
       from customer join nation on c_nationkey = n_nationkey""",
)
def assemble_context(spark, sf_dir):
    """``title`` comes from the template, the organisation and the document: later wins."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(
        "c_custkey",
        F.col("c_nationkey").alias("org_id"),
        F.format_string("set%d", F.col("c_custkey") % 4).alias("parameter_set_name"),
        F.col("c_mktsegment").alias("template_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("title"),
    )
    first = L.first_match(parameters(spark), "parameter_set_name", ["_id"], ["parameters"])
    segments = c.select("c_mktsegment").distinct().select(
        F.col("c_mktsegment").alias("name"), F.concat(F.lit("seg "), F.col("c_mktsegment")).alias("title")
    )
    orgs = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("title"), F.col("n_name").alias("client_name")
    )
    return L.assemble_context(
        docs,
        [
            (first, "parameter_set_name", "parameter_set_name"),
            (segments, "template_name", "name"),
            (orgs, "org_id", "nation_key"),
        ],
    )


@query(
    "lookup_tiers",
    """with brands as (select p_brand, min(p_name) as m, count(*) as n from part where p_size > 45 group by 1),
            types as (select p_type, min(p_name) as m, count(*) as n from part group by 1),
            req as (select s_suppkey, 'Brand#' || s_suppkey % 40 as brand,
                           case s_suppkey % 3 when 0 then 'PROMO' when 1 then 'SMALL' else 'NONE' end as kind from supplier)
       select s_suppkey, brand, kind,
              cast(case when b.p_brand is not null then 1 when t.p_type is not null then 2 else 0 end as integer) as tier,
              coalesce(b.m, t.m, 'default') as match, coalesce(b.n, t.n, 0) as n_matches
       from req left join brands b on brand = b.p_brand left join types t on kind = t.p_type""",
)
def lookup_tiers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "PROMO").when(F.col("s_suppkey") % 3 == 1, "SMALL").otherwise("NONE")
    requests = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 40).cast("string")).alias("brand"), kind.alias("kind")
    )
    tiers = [("brand", p.where("p_size > 45"), "p_brand"), ("kind", p, "p_type")]
    return L.lookup_tiers(requests, tiers, "p_name", F.lit("default"))


@query(
    "pick_default",
    """with opt as (select distinct c_nationkey, c_mktsegment from customer where c_acctbal > 9500),
            req as (select c_custkey, c_nationkey, c_mktsegment from customer)
       select c_custkey, c_nationkey, c_mktsegment,
              coalesce((select o.c_mktsegment from opt o where o.c_nationkey = req.c_nationkey and o.c_mktsegment = req.c_mktsegment),
                       (select min(o.c_mktsegment) from opt o where o.c_nationkey = req.c_nationkey), 'none') as picked
       from req""",
)
def pick_default(spark, sf_dir):
    """Segments with a rich customer in the nation are the options."""
    c = table(spark, sf_dir, "customer")
    options = c.where("c_acctbal > 9500").select("c_nationkey", "c_mktsegment")
    wanted = c.select("c_custkey", "c_nationkey", "c_mktsegment")
    return L.pick_default(wanted, options, "c_nationkey", "c_mktsegment", "c_mktsegment", F.lit("none"))


@query(
    "route_by_type",
    """select event_id, event_type, case event_type when 'click' then 'ui.button' when 'view' then 'ui.page'
              when 'purchase' then 'shop.order' end as target,
              case when event_type in ('error', 'signup') then 'unknown type: ' || event_type end as error
       from events""",
)
def route_by_type(spark, sf_dir):
    mapping = {"click": "ui.button", "view": "ui.page", "purchase": "shop.order"}
    return L.route_by_type(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", mapping)


@query(
    "missing_ids",
    "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
)
def missing_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return unknown_ids(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey")


# -- sets ---------------------------------------------------------------------
@query(
    "set_union",
    """select c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
       union all select s_name, s_acctbal, null from supplier""",
)
def set_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return L.union_all(c, s)


@query(
    "set_except",
    """select distinct p_brand from part where p_brand <> 'Brand#7'
       and p_brand not in (select p_brand from part where p_size = 50 and p_type = 'PROMO')""",
)
def set_except(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return L.difference(p, p.where("p_size = 50 and p_type = 'PROMO'"), "p_brand", excluded=["Brand#7"])


@query("set_first_non_empty", "select p_partkey, p_name from part where p_type = 'PROMO'")
def set_first_non_empty(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    tiers = [p.where("p_brand = 'Brand#0'").where("p_type = 'NONE'"), p.where("p_type = 'PROMO'"), p]
    return L.first_non_empty_set(*tiers).select("p_partkey", "p_name")


# -- sort, limit, pages -------------------------------------------------------
ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def preceded(ordered, key):
    """Rows of a sorted frame with the ``key`` of the row before, over all rows.

    The sort leaves ranges in order; rows meet their neighbour inside a range, and the first
    row of a range the last one of the range before, from a table with a row a range.
    """
    from pyspark.sql import Window

    placed = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
    placed = stored_once(placed)
    ends = placed.groupBy("_range").agg(F.max_by(key, "_at").alias("_last"))
    ends = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_end"))
    inside = F.lag(key).over(Window.partitionBy("_range").orderBy("_at"))
    rows = placed.withColumn("_inside", inside).join(ends, "_range")
    return rows.withColumn("before", F.coalesce("_inside", "_end"))


def stored_once(df):
    """Written below the shared folder and read back, so that the order is taken once."""
    path = scratch(df.sparkSession, "sorted")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(
    "sort_spec",
    """select o_orderkey, o_orderstatus, o_totalprice,
              lag(o_orderkey) over (order by o_orderstatus desc, o_totalprice desc, o_orderkey) as before
       from orders""",
)
def sort_spec(spark, sf_dir):
    """Malformed items are ignored; ``-1`` means descending in a list as well."""
    sort = [{"o_orderstatus": "DESC"}, {"a": 1, "b": 1}, 7, {"o_totalprice": -1}]
    found = Q.retrieve(table(spark, sf_dir, "orders"), sort=sort, tiebreak="o_orderkey")
    return preceded(found, "o_orderkey").select(*ORDER_COLUMNS, "before")


@query(
    "sort_multi",
    """select _id, lag(_id) over (order by event_type, k desc, value, _id) as before
       from (select cast(event_id as varchar) as _id, event_type,
                    cast(regexp_extract(props, '[0-9]+') as integer) as k, value from events)""",
)
def sort_multi(spark, sf_dir):
    from .adapters import event_doc

    sort = ["event_type", {"props.k": "desc"}, {"value": "asc"}]
    return preceded(Q.retrieve(event_doc(spark, sf_dir), sort=sort), "_id").select("_id", "before")


@query(
    "sort_typed",
    MIXED_SQL
    + """select _id, size_str as size_text,
                lag(_id) over (order by size_num desc nulls last, size_str desc nulls last, _id) as before from mixed""",
)
def sort_typed(spark, sf_dir):
    """Numbers under ``size`` first (as numbers), then strings (as strings)."""
    sort = {"size:number": -1, "size:string": "descending"}
    text = F.when(F.col("_id").startswith("c"), F.try_variant_get("v", "$.size", "string"))
    found = preceded(Q.retrieve(mixed_doc(spark, sf_dir), sort=sort), "_id")
    return found.select("_id", text.alias("size_text"), "before")


@query(
    "topk",
    """select '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' as doc
       from orders where o_orderstatus = 'O' and o_totalprice > 100000
       order by o_totalprice desc, o_orderkey limit 20""",
)
def topk(spark, sf_dir):
    return Q.retrieve(
        table(spark, sf_dir, "orders"),
        {"o_orderstatus": "O", "o_totalprice": {"$gt": 100000}},
        ["o_orderkey", "o_orderpriority"],
        {"o_totalprice": "desc"},
        20,
        tiebreak="o_orderkey",
    )


def walked(df, sort, key, size, most=400):
    """All pages of ``df``, one after the other, each row with the number of its page."""
    mark, pages = None, []
    for number in range(most):
        page = Q.retrieve(df, sort=sort, limit=size, tiebreak=key, bookmark=mark)
        mark = Q.bookmark_of(df, sort, key, page)
        if mark is None:
            break
        pages.append(page.select(key, F.lit(number).alias("page")))
    return reduce(lambda a, b: a.union(b), pages)


@query(
    "pages_of_documents",
    MIXED_SQL
    + """select _id, cast(floor((row_number() over (order by case when size_num is not null then 1 when size_str is not null then 2 else 0 end,
                size_num nulls first, size_str nulls first, _id) - 1) / (select ceil(count(*) / 4.0) from mixed)) as integer) as page from mixed""",
)
def pages_of_documents(spark, sf_dir):
    """Pages through documents of different kinds, sorted by a document field."""
    docs = mixed_doc(spark, sf_dir)
    return walked(docs, {"size": 1}, "_id", -(-docs.count() // 4))


@query(
    "pages_without_sort",
    """select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / (select ceil(count(*) / 5.0) from orders)) as integer) as page
       from orders""",
)
def pages_without_sort(spark, sf_dir):
    """Pages without a sort are in key order and bring every row once."""
    orders = table(spark, sf_dir, "orders")
    return walked(orders, None, "o_orderkey", -(-orders.count() // 5))


@query(
    "page_2",
    """select o_orderkey, o_orderstatus, o_totalprice from orders
       order by o_orderdate desc, o_orderstatus, o_orderkey limit 50 offset 50""",
)
def page_2(spark, sf_dir):
    """The second page starts behind the bookmark of the first."""
    o, sort = table(spark, sf_dir, "orders"), {"o_orderdate": "desc", "o_orderstatus": 1}
    first = Q.retrieve(o, sort=sort, limit=50, tiebreak="o_orderkey")
    mark = Q.bookmark_of(o, sort, "o_orderkey", first)
    return Q.retrieve(o, sort=sort, limit=50, tiebreak="o_orderkey", bookmark=mark).select(*ORDER_COLUMNS)
