"""Document-shaped inputs made from the flat tables.

Every adapter is row-local (or a join with a dimension): no rows are gathered
into a document, so no key can make one document or one task large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def envelope(df: DataFrame, id_column, body, keep=()) -> DataFrame:
    """``_id, doc, v`` from a struct column or a JSON text column."""
    return df.select(id_column.cast("string").alias("_id"), *keep, body.alias("doc")).withColumn(
        "v", F.try_parse_json("doc")
    )


def text_time(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def event_doc(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    body = F.to_json(
        F.struct(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.from_json("props", "k INT").alias("props"),
            text_time("ts").alias("ts"),
        )
    )
    return envelope(e, F.col("event_id"), body)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of all rows, dealt over all cores by their values where the files are in few parts.

    A file's row group is read by one task, however many rows it packs; work that is dear for each row
    would run in that task.  All columns deal, so that an id that is null or repeats gathers no rows.
    """
    rows, parts = df.select(*columns), 3 * df.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, *columns)


LINE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
    "l_discount", "l_tax", "l_quantity", "l_extendedprice",
)


def dealt_line_doc(spark, sf_dir) -> DataFrame:
    """``line_doc`` for work that is dear for each row."""
    return line_doc(spark, sf_dir, dealt(table(spark, sf_dir, "lineitem"), *LINE_COLUMNS))


def line_doc(spark, sf_dir, line: DataFrame | None = None) -> DataFrame:
    """One document per order line: arrays of scalars and of objects, some empty."""
    line = table(spark, sf_dir, "lineitem") if line is None else line
    charge = [
        F.when(F.col(f"l_{kind}") > 0, F.struct(F.lit(kind).alias("kind"), F.col(f"l_{kind}").alias("rate")))
        for kind in ("discount", "tax")
    ]
    body = F.struct(
        F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("line"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.array_compact(F.array(*charge)).alias("charges"),
        F.struct(
            F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").alias("price")
        ).alias("sale"),
    )
    # the VARIANT comes from the struct itself: no JSON text is written and read back
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_id"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.to_json(body).alias("doc"),
        F.to_variant_object(body).alias("v"),
    )


def with_note(doc, condition):
    """Add an explicit JSON null where ``condition`` holds."""
    return F.when(condition, F.concat(F.lit('{"note":null,'), F.substr(doc, F.lit(2)))).otherwise(doc)


def mixed_doc(spark, sf_dir) -> DataFrame:
    """Customers, suppliers and parts in one collection, with clashing types."""
    c = table(spark, sf_dir, "customer")
    customer = envelope(
        c,
        F.concat(F.lit("c"), F.col("c_custkey")),
        with_note(
            F.to_json(
                F.struct(
                    F.lit("customer").alias("type"),
                    F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nation"),
                    F.col("c_acctbal").alias("balance"),
                    F.when(
                        F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 50).cast("string")
                    ).alias("size"),
                    F.col("c_mktsegment").alias("segment"),
                )
            ),
            F.col("c_custkey") % 7 == 0,
        ),
    )
    s = table(spark, sf_dir, "supplier")
    supplier = envelope(
        s,
        F.concat(F.lit("s"), F.col("s_suppkey")),
        F.to_json(
            F.struct(
                F.lit("supplier").alias("type"),
                F.col("s_name").alias("name"),
                F.col("s_nationkey").alias("nation"),
                F.col("s_acctbal").alias("balance"),
                (F.col("s_acctbal") > 0).alias("active"),
            )
        ),
    )
    p = table(spark, sf_dir, "part")
    part = envelope(
        p,
        F.concat(F.lit("p"), F.col("p_partkey")),
        F.to_json(
            F.struct(
                F.lit("part").alias("type"),
                F.col("p_name").alias("name"),
                F.col("p_size").alias("size"),
                F.col("p_brand").alias("brand"),
                F.col("p_retailprice").alias("price"),
            )
        ),
    )
    return customer.unionByName(supplier).unionByName(part)


# The same collection for the SQL checks, one column per possible kind of value.
MIXED_SQL = """
with mixed as (
  select 'c' || c_custkey as _id, 'customer' as type, c_name as name, c_nationkey as nation,
         c_acctbal as balance, case when c_custkey % 2 = 0 then cast(c_custkey % 50 as varchar) end as size_str,
         cast(null as integer) as size_num, c_custkey % 7 = 0 as has_note, c_mktsegment as segment,
         cast(null as varchar) as brand, cast(null as double) as price, cast(null as boolean) as active
  from customer
  union all
  select 's' || s_suppkey, 'supplier', s_name, s_nationkey, s_acctbal, null, null, false, null, null, null,
         s_acctbal > 0 from supplier
  union all
  select 'p' || p_partkey, 'part', p_name, null, null, null, p_size, false, null, p_brand, p_retailprice, null
  from part
)
"""

LINE_SQL = """
with line as (
  select *, l_orderkey || '-' || l_linenumber as _id,
         (case when l_discount > 0 then 1 else 0 end) + (case when l_tax > 0 then 1 else 0 end) as n_charges,
         cast(l_quantity as integer) as qty
  from lineitem
)
"""


def context_doc(spark, sf_dir) -> DataFrame:
    """Every customer as an organisation: a union-typed field, quotes, blanks to prune."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    even = F.col("c_custkey") % 2 == 0
    listed = F.to_variant_object(F.array(F.col("c_mktsegment"), F.concat(F.lit(" plan "), F.col("n_nationkey"))))
    named = F.to_variant_object(
        F.create_map(
            F.lit("main"), F.col("c_mktsegment"), F.lit("side"), F.concat(F.lit(" for "), F.col("r_name")),
            F.lit("void"), F.lit("  "),
        )
    )
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey"),
        F.format_string("org%d", F.col("c_custkey")).alias("org_id"),
        F.when(F.col("r_regionkey") > 0, F.col("r_name")).alias("language"),
        F.struct(
            F.col("c_name").alias("client_name"),
            F.concat(F.lit("  It's in "), F.col("n_name"), F.lit(" \n")).alias("org_description"),
            F.when(even, listed).otherwise(named).alias("offerings"),
            F.array(
                F.struct(F.col("n_name").alias("original"), F.col("r_name").alias("replacement")),
                F.struct(F.lit(" ").alias("original"), F.lit("").alias("replacement")),
            ).alias("terminology_mapping"),
            F.array(
                F.struct(F.col("c_mktsegment").alias("term"), F.col("n_name").alias("definition")),
                F.struct(F.col("r_name").alias("term"), F.lit("region").alias("definition")),
            ).alias("taxonomy"),
            F.array(F.col("n_name"), F.lit(" "), F.col("r_name")).alias("location_operations"),
            F.col("c_acctbal").alias("balance"),
        ).alias("org_context"),
    )


CONTEXT_SQL = """
with ctx as (
  select c_custkey, 'org' || c_custkey as org_id, c_name, c_mktsegment, c_acctbal, n_name, n_nationkey, r_name,
         case when r_regionkey > 0 then r_name end as language
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)
"""


def words(text):
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("bigint")


def turns(spark, sf_dir) -> DataFrame:
    """Conversation turns with token usage: none for system, one-sided for the rest."""
    c = table(spark, sf_dir, "conversations")
    n = words(F.col("text"))
    usage = F.struct(
        F.when(F.col("role") == "user", n).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", n).alias("completion_tokens"),
        F.when(F.col("role") != "system", n).alias("total_tokens"),
    )
    return c.withColumn("usage", usage)


TURNS_SQL = r"""
with turns as (
  select *, case when role <> 'system' then cast(len(regexp_extract_all(text, '\S+')) as bigint) end as total_tokens,
         case when role = 'user' then cast(len(regexp_extract_all(text, '\S+')) as bigint) end as prompt_tokens,
         case when role = 'assistant' then cast(len(regexp_extract_all(text, '\S+')) as bigint) end as completion_tokens
  from conversations
)
"""
