"""Projection and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import prune_json, restore_key_order
from ..functions.pytext import variant_repr
from ..operators import reshape as R
from .adapters import CONTEXT_SQL, LINE_SQL, context_doc, event_doc, line_doc, mixed_doc, table
from .registry import query


@query(
    "project_dotted",
    """
    select 'c' || c_custkey as _id,
           '{"name":"' || c_name || '"' ||
           case when c_custkey % 2 = 0 then ',"size":"' || (c_custkey % 50) || '"' else '' end || '}' as doc
    from customer
    union all select 's' || s_suppkey, '{"name":"' || s_name || '"}' from supplier
    union all select 'p' || p_partkey, '{"name":"' || p_name || '","size":' || p_size || '}' from part
    """,
)
def project_dotted(spark, sf_dir):
    """Absent and null fields are left out (``note`` is only ever null or absent)."""
    return R.project(mixed_doc(spark, sf_dir), ["name", "note", "size", "size.unit"], include_id=True)


@query(
    "project_nested",
    LINE_SQL
    + """select '{"sale":{"qty":' || qty || '},"flags":["' || l_returnflag || '","' || l_linestatus || '"]}' as doc
         from line""",
)
def project_nested(spark, sf_dir):
    return R.project(line_doc(spark, sf_dir), ["sale.qty", "sale.none.x", "flags"])


@query(
    "project_flags",
    """select '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as doc from orders""",
)
def project_flags(spark, sf_dir):
    flags = {"o_orderkey": 1, "o_custkey": 0, "o_orderstatus": True, "o_totalprice": None}
    return R.project(table(spark, sf_dir, "orders"), flags)


@query(
    "project_with_id",
    """select cast(o_orderkey as varchar) as _id, '{"o_orderpriority":"' || o_orderpriority || '"}' as doc
       from orders""",
)
def project_with_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey").cast("string"))
    return R.project(orders, {"fields": ["o_orderpriority"]}, include_id=True)


@query(
    "remap_keys",
    """select c_custkey, 'id,label,segment' as keys, c_mktsegment as label, c_name as segment from customer""",
)
def remap_keys(spark, sf_dir):
    """``c_mktsegment`` lands on ``label`` after ``c_name`` did: the later key wins."""
    doc = F.to_json(
        F.struct(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("label"),
            F.col("c_name").alias("segment"),
            F.col("c_mktsegment").alias("market"),
        )
    )
    mapped = R.remap_keys(R.document_map(doc), {"market": "label"})
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array_join(F.map_keys(mapped), ",").alias("keys"),
        F.try_variant_get(mapped["label"], "$", "string").alias("label"),
        F.try_variant_get(mapped["segment"], "$", "string").alias("segment"),
    )


@query(
    "prune_empty",
    CONTEXT_SQL
    + """select org_id, 'It''s in ' || n_name as description, n_name || '|' || r_name as locations,
         cast(1 as bigint) as n_terms,
         case when c_custkey % 2 = 0 then '["' || c_mktsegment || '","plan ' || n_nationkey || '"]'
              else '{"main":"' || c_mktsegment || '","side":"for ' || r_name || '"}' end as offerings
         from ctx""",
)
def prune_empty(spark, sf_dir):
    pruned = R.prune_column(context_doc(spark, sf_dir), "org_context")
    c = F.col("org_context")
    return pruned.select(
        "org_id",
        c["org_description"].alias("description"),
        F.array_join(c["location_operations"], "|").alias("locations"),
        F.size(c["terminology_mapping"]).cast("bigint").alias("n_terms"),
        F.to_json(c["offerings"]).alias("offerings"),
    )


@query(
    "records_to_map",
    """select event_id, cast(user_id as bigint) as k, event_type as kind, cast(2 as bigint) as n_keys from events""",
)
def records_to_map(spark, sf_dir):
    """The ``k`` of the properties is overridden by a later record with the same key."""
    k = F.get_json_object("props", "$.k")
    record = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    records = F.array(record("k", k), record("kind", F.col("event_type")), record("k", F.col("user_id")))
    merged = R.records_to_map(records)
    return table(spark, sf_dir, "events").select(
        "event_id",
        merged["k"].cast("bigint").alias("k"),
        merged["kind"].alias("kind"),
        F.size(R.map_to_records(merged)).cast("bigint").alias("n_keys"),
    )


@query(
    "key_order",
    """select event_id, 'event_id,user_id,event_type,value,props,ts,added' as keys,
              '{"z":' || user_id || ',"k":' || cast(regexp_extract(props, '[0-9]+') as integer) || '}' as inner_text
       from events""",
)
def key_order(spark, sf_dir):
    """A round trip through VARIANT sorts keys; the original's order comes back."""
    docs = event_doc(spark, sf_dir)
    user, k = F.get_json_object("doc", "$.user_id"), F.get_json_object("doc", "$.props.k")
    props = F.format_string('"props":{"z":%s,"k":%s}', user, k)
    original = F.regexp_replace("doc", F.lit('"props":[{][^}]*[}]'), props)
    changed = F.parse_json(F.concat(F.lit('{"added":1,'), F.substr(original, F.lit(2))))
    ordered = restore_key_order(changed, original)
    return docs.select(
        F.col("_id").cast("bigint").alias("event_id"),
        F.array_join(F.json_object_keys(ordered), ",").alias("keys"),
        F.regexp_extract(ordered, '"props":([{][^}]*[}])', 1).alias("inner_text"),
    )


TEMPLATE = {
    "org_context": {
        "terminology_mapping": [{"original": "string", "replacement": "string"}],
        "location_operations": ["string"],
        "offerings": {
            "oneOf": [
                {"type": "array", "items": "string"},
                {"type": "object", "additionalProperties": "string"},
            ]
        },
    }
}


@query(
    "schema_from_template",
    CONTEXT_SQL
    + """select org_id, n_name as original, r_name as replacement from ctx
         union all select org_id, ' ', '' from ctx""",
)
def schema_from_template(spark, sf_dir):
    from pyspark.sql import types as T

    row_type = R.columns_from_template(TEMPLATE)
    text = F.to_json(F.col("org_context.terminology_mapping"))
    return context_doc(spark, sf_dir).select(
        "org_id", F.inline(F.from_json(text, T.ArrayType(row_type)))
    )


@query(
    "typed_rows",
    """select p_partkey, cast(r.range as integer) as "row", '-' as note, cast(0 as bigint) as n, cast(0.0 as double) as x,
              false as flag
       from part join (select range from range(1, 1000)) r on r.range <= p_size""",
)
def typed_rows(spark, sf_dir):
    """As many blank rows per part as its size says."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    columns = {"note": "str", "n": "int64", "x": "float64", "flag": "bool"}
    return R.typed_rows_for(parts, F.col("p_size"), columns, fill="-").drop("p_size")


@query(
    "labelled_options",
    "select c_name || ' (' || c_custkey || ')' as label, c_custkey as option from customer",
)
def labelled_options(spark, sf_dir):
    return R.labelled_options(table(spark, sf_dir, "customer"), "c_name", "c_custkey")


@query(
    "label_fallback",
    """select label, max(p_partkey) as option from (
         select p_partkey, case when p_size > 25 then p_name when p_size > 10 then p_brand
                                else cast(p_partkey as varchar) end as label from part)
       group by label""",
)
def label_fallback(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("display_name"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("name"),
    )
    return R.label_rows(parts, ["display_name", "name", "p_partkey"], "p_partkey", "p_partkey")


DEEP = 12


def deep_documents(spark, sf_dir):
    """Orders nested in lists and objects twelve levels deep."""
    inner = F.concat(F.lit('{"b":"  '), "o_orderpriority", F.lit('  ","a":'), "o_orderkey", F.lit(',"z":[""," "],"n":null}'))
    text = F.concat(F.lit('[{"k":' * DEEP), inner, F.lit("}]" * DEEP))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(text).alias("v"))


@query(
    "prune_deep",
    f"""select o_orderkey, repeat('[{{"k":', {DEEP}) || '{{"a":' || o_orderkey || ',"b":"' || o_orderpriority || '"}}' || repeat('}}]', {DEEP}) as pruned
        from orders""",
)
def prune_deep(spark, sf_dir):
    return deep_documents(spark, sf_dir).select("o_orderkey", prune_json(F.col("v")).alias("pruned"))


@query(
    "print_deep",
    f"""select o_orderkey, repeat('[{{\'\'k\'\': ', {DEEP}) || '{{\'\'a\'\': ' || o_orderkey || ', \'\'b\'\': \'\'  ' || o_orderpriority
               || '  \'\', \'\'n\'\': None, \'\'z\'\': [\'\'\'\', \'\' \'\']}}' || repeat('}}]', {DEEP}) as printed from orders""",
)
def print_deep(spark, sf_dir):
    return deep_documents(spark, sf_dir).select("o_orderkey", variant_repr(F.col("v")).alias("printed"))


@query(
    "key_order_deep",
    """select o_orderkey, repeat('{"z":0,"k":', 9) || '{"b":' || o_orderkey || ',"a":[{"y":1,"x":2}],"new":1}' || repeat(',"new":1}', 9) as ordered from orders""",
)
def key_order_deep(spark, sf_dir):
    """Keys come back in the original's order nine levels down; keys it lacks come last."""
    inner = F.concat(F.lit('{"b":'), "o_orderkey", F.lit(',"a":[{"y":1,"x":2}]}'))
    original = F.concat(F.lit('{"z":0,"k":' * 9), inner, F.lit("}" * 9))
    changed = F.parse_json(F.replace(original, F.lit("}"), F.lit(',"new":1}')))
    changed = F.parse_json(F.replace(F.to_json(changed), F.lit('{"new":1,"x"'), F.lit('{"x"')))
    return table(spark, sf_dir, "orders").select("o_orderkey", restore_key_order(changed, original).alias("ordered"))
