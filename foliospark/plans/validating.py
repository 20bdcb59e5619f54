"""Validation and conforming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonschema import apply_policy, validate, validate_documents
from ..operators import conform as C
from .adapters import LINE_SQL, MIXED_SQL, envelope, event_doc, line_doc, mixed_doc, table
from .registry import query


def order_doc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    body = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
        )
    )
    return envelope(o, F.col("o_orderkey"), body)


def customer_doc(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    return envelope(c, F.col("c_custkey"), body)


def document_doc(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return envelope(d, F.col("doc_id"), F.to_json(F.struct("text", "lang")))


def error_query(name, source, schema, sql, keep=("_id",), normalized=False, **options):
    """``error`` (and ``normalized`` where asked) per document; no error shows as "-"."""

    @query(name, sql)
    def run(spark, sf_dir):
        out = validate_documents(source(spark, sf_dir), schema, **options)
        more = [F.coalesce("normalized", F.lit("-")).alias("normalized")] if normalized else []
        return out.select(*keep, F.coalesce("error", F.lit("-")).alias("error"), *more)


EVENT = "select cast(event_id as varchar) as _id, "
ORDER = "select cast(o_orderkey as varchar) as _id, "
ORDER_JSON = """'{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '","total":' || rtrim(rtrim(cast(cast(o_totalprice as decimal(18,2)) as varchar), '0'), '.') || '}'"""

error_query("val_default", event_doc, None, EVENT + "'-' as error from events")
error_query(
    "val_type", mixed_doc,
    {"properties": {"size": {"type": ["integer", "boolean"]}, "active": {"type": "boolean"}, "name": {"type": "string"}, "price": {"type": "number"}}},
    MIXED_SQL + """select _id, case when size_str is not null then 'size: value ''' || size_str || ''' is not of type [''integer'', ''boolean'']' else '-' end as error from mixed""",
)
error_query(
    "val_enum", event_doc, {"properties": {"event_type": {"enum": ["click", "view", 3]}}},
    EVENT + """case when event_type in ('click', 'view') then '-' else 'event_type: value ''' || event_type || ''' not in enum [''click'', ''view'', 3]' end as error from events""",
)
error_query(
    "val_const", order_doc, {"properties": {"status": {"const": "O"}}},
    ORDER + """case when o_orderstatus = 'O' then '-' else 'status: value ''' || o_orderstatus || ''' does not equal const ''O''' end as error from orders""",
)
error_query(
    "val_properties", line_doc,
    {"properties": {"sale": {"properties": {"qty": {"maximum": 40}}}, "charges": {"items": {"properties": {"rate": {"maximum": 0.07}}}}}},
    LINE_SQL + """select _id, l_partkey, l_suppkey, case when l_discount > 0.07 then 'charges[0].rate: value ' || l_discount || ' > maximum 0.07'
        when l_tax > 0.07 then 'charges[' || (case when l_discount > 0 then 1 else 0 end) || '].rate: value ' || l_tax || ' > maximum 0.07'
        when qty > 40 then 'sale.qty: value ' || qty || ' > maximum 40' else '-' end as error from line""",
    keep=("_id", "l_partkey", "l_suppkey"),
)
error_query(
    "val_required", mixed_doc, {"required": ["name", "size", "note"], "properties": {"name": {}}},
    MIXED_SQL + """select _id, case when (size_str is not null or size_num is not null) and has_note then '-' else '<root>: missing required fields: [' ||
        concat_ws(', ', case when size_str is null and size_num is null then '''size''' end, case when not has_note then '''note''' end) || ']' end as error from mixed""",
)
error_query(
    "val_default_fill", mixed_doc,
    {"required": ["size"], "additionalProperties": False, "properties": {"type": {}, "size": {"default": 7}, "active": {"default": {"x": [1]}}}},
    MIXED_SQL + """select _id, '-' as error, '{"active":' || coalesce(cast(active as varchar), '{"x":[1]}') || ',"size":' ||
        coalesce('"' || size_str || '"', cast(size_num as varchar), '7') || ',"type":"' || type || '"}' as normalized from mixed""",
    normalized=True,
)
error_query(
    "val_strip", event_doc, {"additionalProperties": False, "properties": {"user_id": {"type": "integer"}, "props": {"type": "object"}}},
    EVENT + """'-' as error, '{"props":{"k":' || regexp_extract(props, '[0-9]+') || '},"user_id":' || user_id || '}' as normalized from events""",
    normalized=True,
)
error_query(
    "val_extra_error", event_doc, {"additionalProperties": False, "properties": {"event_id": {}, "user_id": {}, "props": {"additionalProperties": {"maximum": 50}}}},
    EVENT + """'event_type: additional property not allowed' as error from events""",
    strip_unknown=False,
)
error_query(
    "val_extra_schema", event_doc, {"properties": {"props": {"additionalProperties": {"maximum": 50, "type": "integer"}}}},
    EVENT + """case when k > 50 then 'props.k: value ' || k || ' > maximum 50' else '-' end as error
       from (select *, cast(regexp_extract(props, '[0-9]+') as integer) as k from events)""",
)
error_query(
    "val_items", line_doc, {"properties": {"charges": {"minItems": 1, "maxItems": 1, "items": {"type": "object"}}, "flags": {"items": {"enum": ["N", "O", "F"]}}}},
    LINE_SQL + """select _id, l_partkey, l_suppkey, case when l_returnflag <> 'N' then 'flags[0]: value ''' || l_returnflag || ''' not in enum [''N'', ''O'', ''F'']'
        when n_charges = 0 then 'charges: array has 0 items, minimum is 1' when n_charges = 2 then 'charges: array has 2 items, maximum is 1' else '-' end as error from line""",
    keep=("_id", "l_partkey", "l_suppkey"),
)
error_query(
    "val_length", document_doc, {"properties": {"text": {"minLength": 200, "maxLength": 2000}}},
    """select cast(doc_id as varchar) as _id, case when length(text) < 200 then 'text: string length ' || length(text) || ' < minLength 200'
       when length(text) > 2000 then 'text: string length ' || length(text) || ' > maxLength 2000' else '-' end as error from documents""",
)
error_query(
    "val_range", order_doc, {"properties": {"total": {"minimum": 100000, "maximum": 300000.5}}},
    ORDER + """case when o_totalprice < 100000 then 'total: value ' || o_totalprice || ' < minimum 100000'
       when o_totalprice > 300000.5 then 'total: value ' || o_totalprice || ' > maximum 300000.5' else '-' end as error from orders""",
)
error_query(
    "val_allof", order_doc,
    {"allOf": [{"properties": {"extra": {"default": 1}}}, {"required": ["extra"], "properties": {"status": {"enum": ["O", "F"]}}}]},
    ORDER + """case when o_orderstatus = 'P' then 'status: value ''P'' not in enum [''O'', ''F'']' else '-' end as error,
       case when o_orderstatus = 'P' then '-' else '{"extra":1,' || substr(""" + ORDER_JSON + """, 2) end as normalized from orders""",
    normalized=True,
)
BRANCHES = [{"properties": {"status": {"const": "O"}}}, {"properties": {"total": {"maximum": 100000}}}]


def no_match_sql(word):
    return (
        f"'<root>: value did not match any schema in ''{word}'':' || chr(10) || '  {word}[0]: status: value ''' || o_orderstatus || "
        f"''' does not equal const ''O''' || chr(10) || '  {word}[1]: total: value ' || o_totalprice || ' > maximum 100000'"
    )


for key, word in (("val_anyof", "anyOf"), ("val_oneof", "oneOf")):
    error_query(
        key, order_doc, {word: BRANCHES},
        ORDER + f"case when o_orderstatus = 'O' or o_totalprice <= 100000 then '-' else {no_match_sql(word)} end as error from orders",
    )
error_query(
    "val_oneof_strict", order_doc, {"oneOf": BRANCHES},
    ORDER + f"""case when o_orderstatus = 'O' and o_totalprice <= 100000 then '<root>: matched more than one schema in ''oneOf'''
        when o_orderstatus = 'O' or o_totalprice <= 100000 then '-' else {no_match_sql('oneOf')} end as error from orders""",
    strict_one_of=True,
)
error_query(
    "val_anyof_null", mixed_doc, {"properties": {"note": {"anyOf": [{"type": "null"}]}}},
    MIXED_SQL + """select _id, case when has_note then 'note: value did not match any schema in ''anyOf'':' || chr(10) else '-' end as error from mixed""",
)
error_query(
    "val_not", order_doc, {"not": {"properties": {"status": {"enum": ["F"]}}}, "properties": {"priority": {"not": {"maxLength": 5}}}},
    ORDER + """case when o_orderstatus = 'F' then '<root>: value must not match ''not'' schema'
       when length(o_orderpriority) <= 5 then 'priority: value must not match ''not'' schema' else '-' end as error from orders""",
)
error_query(
    "val_ref", line_doc,
    {"definitions": {"a/b": [{"type": "object", "properties": {"rate": {"$ref": "#/definitions/rate"}}}], "rate": {"maximum": 0.05}},
     "properties": {"charges": {"items": {"$ref": "#/definitions/a~1b/0"}}, "line": {"not": False}, "self": {"$ref": "#"}}},
    LINE_SQL + """select _id, l_partkey, l_suppkey, case when l_discount > 0.05 then 'charges[0].rate: value ' || l_discount || ' > maximum 0.05'
        when l_tax > 0.05 then 'charges[' || (case when l_discount > 0 then 1 else 0 end) || '].rate: value ' || l_tax || ' > maximum 0.05' else '-' end as error from line""",
    keep=("_id", "l_partkey", "l_suppkey"),
)
error_query(
    "val_first_error", mixed_doc,
    {
        "type": "object", "required": ["name"],
        "allOf": [{"not": {"properties": {"type": {"const": "supplier"}}, "required": ["type"]}}],
        "properties": {
            "name": {"type": "string", "minLength": 9}, "size": {"anyOf": [{"type": "integer", "maximum": 40}, {"type": "string", "maxLength": 1}]},
            "brand": {"enum": ["Brand#1", "Brand#2", "Brand#3"]}, "balance": {"minimum": 0}, "segment": {"not": {"const": "BUILDING"}},
        },
    },
    MIXED_SQL + """select _id, case when type = 'supplier' then '<root>: value must not match ''not'' schema'
        when length(name) < 9 then 'name: string length ' || length(name) || ' < minLength 9'
        when balance < 0 then 'balance: value ' || balance || ' < minimum 0'
        when length(size_str) > 1 then 'size: value did not match any schema in ''anyOf'':' || chr(10) || '  anyOf[0]: size: value ''' || size_str || ''' is not of type integer' || chr(10)
             || '  anyOf[1]: size: string length ' || length(size_str) || ' > maxLength 1'
        when segment = 'BUILDING' then 'segment: value must not match ''not'' schema'
        when size_num > 40 then 'size: value did not match any schema in ''anyOf'':' || chr(10) || '  anyOf[0]: size: value ' || size_num || ' > maximum 40' || chr(10)
             || '  anyOf[1]: size: value ' || size_num || ' is not of type string'
        when brand not in ('Brand#1', 'Brand#2', 'Brand#3') then 'brand: value ''' || brand || ''' not in enum [''Brand#1'', ''Brand#2'', ''Brand#3'']'
        else '-' end as error from mixed""",
)
error_query(
    "val_key_mapping", customer_doc, {"required": ["name"], "additionalProperties": False, "properties": {"name": {}, "segment": {}}},
    """select cast(c_custkey as varchar) as _id, '-' as error, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' as normalized from customer""",
    normalized=True, key_mapping={"full_name": "name"},
)


# -- schemas that refer to themselves, and records kept in their own order ------------------
CHAIN = 12
CHAIN_SCHEMA = {
    "type": "object", "required": ["key"], "additionalProperties": False,
    "properties": {"key": {"type": "integer", "maximum": 40000}, "next": {"$ref": "#"}, "tag": {"default": "none"}},
}


def dealt(flat):
    """Rows dealt out anew while they are short, as what is made of them takes far longer than to read them."""
    spark = flat.sparkSession
    return flat.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def chain_doc(spark, sf_dir):
    """Orders as links in links, twelve deep; the innermost holds the order's own values."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    inner = F.concat(F.lit('{"key":'), "o_orderkey", F.lit(',"status":"'), "o_orderstatus", F.lit('"}'))
    return envelope(o, F.col("o_orderkey"), F.concat(F.lit('{"key":1,"next":' * CHAIN), inner, F.lit("}" * CHAIN)))


error_query(
    "val_chain", chain_doc, CHAIN_SCHEMA,
    f"""select cast(o_orderkey as varchar) as _id,
        case when o_orderkey > 40000 then repeat('next.', {CHAIN}) || 'key: value ' || o_orderkey || ' > maximum 40000' else '-' end as error,
        case when o_orderkey > 40000 then '-' else repeat('{{"key":1,"next":', {CHAIN}) || '{{"key":' || o_orderkey || ',"tag":"none"}}' ||
          repeat(',"tag":"none"}}', {CHAIN}) end as normalized from orders""",
    normalized=True,
)


def tree_doc(spark, sf_dir):
    """Customers as trees of two kinds of branches."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    leaf = F.concat(F.lit('{"n":'), F.col("c_custkey") % 10, F.lit("}"))
    side = F.concat(F.lit('{"n":'), F.col("c_nationkey"), F.lit(',"right":{"left":'), leaf, F.lit("}}"))
    return envelope(c, F.col("c_custkey"), F.concat(F.lit('{"right":['), side, F.lit(","), leaf, F.lit('],"left":'), side, F.lit("}")))


error_query(
    "val_tree", tree_doc,
    {
        "definitions": {"branch": {"properties": {"left": {"$ref": "#/definitions/branch"}, "right": {"$ref": "#/definitions/side"}, "n": {"maximum": 6}}},
                        "side": {"anyOf": [{"type": "array", "items": {"$ref": "#/definitions/branch"}}, {"type": "object", "required": ["left"], "additionalProperties": {"$ref": "#/definitions/branch"}}]}},
        "$ref": "#/definitions/branch",
    },
    """with c as (select cast(c_custkey as varchar) as _id, c_custkey % 10 as k, c_nationkey as n from customer),
       s as (select *, 'value did not match any schema in ''anyOf'':' || chr(10) as head from c),
       inner_ as (select *, case when n > 6 then 'P.n: value ' || n || ' > maximum 6' when k > 6 then 'P.right: ' || head ||
           '  anyOf[0]: P.right: value {''left'': {''n'': ' || k || '}} is not of type array' || chr(10) || '  anyOf[1]: P.right.left.n: value ' || k || ' > maximum 6' end as bad from s),
       list_ as (select *, coalesce(replace(bad, 'P', 'right[0]'), case when k > 6 then 'right[1].n: value ' || k || ' > maximum 6' end) as first from inner_)
       select _id, case when first is not null then 'right: ' || head || '  anyOf[0]: ' || first || chr(10) ||
           '  anyOf[1]: right: value [{''n'': ' || n || ', ''right'': {''left'': {''n'': ' || k || '}}}, {''n'': ' || k || '}] is not of type object'
         when bad is not null then replace(bad, 'P', 'left') else '-' end as error from list_""",
)
error_query(
    "val_nested_first", lambda spark, sf_dir: nested_doc(spark, sf_dir),
    {"properties": {"p": {"properties": {"b": {"maximum": 10}, "z": {"maximum": 10}}}, "l": {"items": {"properties": {"b": {"maximum": 10}, "z": {"maximum": 10}}}}}},
    """select cast(p_partkey as varchar) as _id, case when p_size <= 10 then '-' when p_partkey % 2 = 0 then 'l[1].z: value ' || p_size || ' > maximum 10'
       else 'p.z: value ' || p_size || ' > maximum 10' end as error from part""",
)


def nested_doc(spark, sf_dir):
    """Parts with keys out of order inside a nested object and a list, whichever comes first."""
    p = table(spark, sf_dir, "part")
    pair = F.concat(F.lit('{"z":'), "p_size", F.lit(',"b":'), "p_size", F.lit("}"))
    one, two = F.concat(F.lit('"p":'), pair), F.concat(F.lit('"l":[{},'), pair, F.lit("]"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(two, F.lit(","), one)).otherwise(F.concat(one, F.lit(","), two))
    return envelope(p, F.col("p_partkey"), F.concat(F.lit("{"), body, F.lit("}")))


def spelled_doc(spark, sf_dir):
    """Parts with unsorted keys at several levels and numbers written in their own way."""
    p = table(spark, sf_dir, "part")
    inner = F.concat(F.lit('{"size": '), "p_size", F.lit('.0, "brand": "'), "p_brand", F.lit('", "extra": 1}'))
    return envelope(p, F.col("p_partkey"), F.concat(F.lit('{"z": 1.50, "inner": '), inner, F.lit(', "a": [1.0, {"d": 1e2, "c": 2}]}')))


error_query(
    "val_record_text", spelled_doc,
    {"properties": {"inner": {"additionalProperties": False, "properties": {"size": {"type": "number"}, "brand": {}, "added": {"default": [2]}}}}},
    """select cast(p_partkey as varchar) as _id, '-' as error, '{"z":1.50,"inner":{"size":' || p_size || '.0,"brand":"' || p_brand ||
       '","added":[2]},"a":[1.0,{"d":1e2,"c":2}]}' as normalized from part""",
    normalized=True, record_order=True,
)


@query(
    "val_policy",
    MIXED_SQL + """select _id, size_num is not null as plain_kept, true as covered_kept, case when size_num is not null then 'null' else 'value' end as covered_size from mixed""".replace(
        "size_num is not null as plain_kept", "type = 'part' as plain_kept"
    ).replace("case when size_num is not null then 'null' else 'value' end as covered_size", "size_str is not null as covered_has_size"),
)
def val_policy(spark, sf_dir):
    """Passthrough does not cover reported errors unless asked to."""
    docs = mixed_doc(spark, sf_dir)
    schema = {"properties": {"type": {"const": "part"}, "size": {}}, "additionalProperties": False}
    r = docs.withColumn("r", validate(F.col("v"), {"allOf": [schema]}))
    covered = apply_policy(F.col("r"), F.col("doc"), "passthrough", cover_reported=True)
    size = F.get_json_object(covered, "$.size")
    return r.select(
        "_id",
        apply_policy(F.col("r"), F.col("doc"), "passthrough").isNotNull().alias("plain_kept"),
        covered.isNotNull().alias("covered_kept"),
        (size.isNotNull() & F.col("_id").startswith("c")).alias("covered_has_size"),
    )


@query(
    "val_null",
    MIXED_SQL + """select _id, case when has_note then '-' else '''data'' is required in the input payload' end as error from mixed where has_note
       union all select _id, '''data'' is required in the input payload' from mixed""".replace(
        "case when has_note then '-' else '''data'' is required in the input payload' end as error from mixed where has_note",
        "'''data'' is required in the input payload' as error from mixed where has_note",
    ),
)
def val_null(spark, sf_dir):
    """A JSON null and an absent value are both missing data."""
    docs = mixed_doc(spark, sf_dir)
    note = docs.select("_id", F.try_variant_get("v", "$.note", "variant").alias("v")).where("v is not null")
    none = docs.select("_id", F.try_variant_get("v", "$.nothing", "variant").alias("v"))
    return validate_documents(note.unionByName(none), {"type": "string"}).select("_id", "error")


@query(
    "val_log",
    """select cast(event_id as varchar) as _id, case when event_type = 'error' then '-' else
         '[1/4] Schema parsed successfully' || chr(10) || '[2/4] Applied key_mapping: {''user_id'': ''user''}' || chr(10) ||
         '[3/4] Validating data against schema (strip_unknown=True)' || chr(10) || '[4/4] Validation complete' end as log from events""",
)
def val_log(spark, sf_dir):
    schema = {"required": ["user"], "properties": {"event_type": {"not": {"const": "error"}}}}
    out = validate_documents(event_doc(spark, sf_dir), schema, verbose=True, key_mapping={"user_id": "user"})
    return out.select("_id", F.coalesce(F.array_join("log", "\n"), F.lit("-")).alias("log"))


# -- conforming ---------------------------------------------------------------
SPEC = C.Spec(
    params=("self", "event_type", "value", "props", "label", "user_id"),
    required=("self", "value", "label"),
    types={"event_type": "Sequence[int]", "props": "dict[str, int] | None", "value": "str", "user_id": "str", "label": "str | None"},
)


def conform_query(name, sql, build, source=event_doc, keep=("_id",)):
    @query(name, sql)
    def run(spark, sf_dir):
        return source(spark, sf_dir).select(*keep, build(F.col("doc")).alias("doc"))


ENTRIES = lambda doc: F.from_json(doc, "map<string,variant>")
K = "regexp_extract(props, '[0-9]+')"
VALUE = "case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end"

conform_query(
    "conf_filter",
    EVENT + f"""'{{"user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || {VALUE} || ',"props":{{"k":' || {K} || '}}}}' as doc from events""",
    lambda d: C.restore_param_order(C.keep_known(ENTRIES(d), SPEC), F.json_object_keys(d)),
)
conform_query(
    "conf_fill",
    EVENT + """'{"event_type":"' || event_type || '","label":null,"missing":[]}' as doc from events""",
    lambda d: C.restore_param_order(
        C.fill_required(
            C.fill_required(C.keep_known(ENTRIES(d), C.Spec(params=("event_type",))), C.Spec((), ("event_type", "label", "self"))),
            C.Spec((), ("missing",)), [],
        ),
        F.json_object_keys(d),
    ),
)
conform_query(
    "conf_cast",
    MIXED_SQL + """select _id, case type
        when 'customer' then '{"type":["customer"],"name":"' || name || '"' || case when size_str is not null then ',"size":' || size_str else '' end || ',"note":' || case when has_note then '[null]' else '0' end || '}'
        when 'supplier' then '{"type":["supplier"],"name":"' || name || '","active":' || active || ',"note":0}'
        else '{"type":["part"],"name":"' || name || '","size":' || size_num || ',"note":0}' end as doc from mixed""",
    lambda d: C.restore_param_order(
        F.map_concat(
            C.coerce(
                C.keep_known(ENTRIES(d), C.Spec(("type", "name", "size", "active", "note"))), C.Spec(()),
                {"type": "list", "name": "int", "size": "int", "active": "str", "note": "list"},
            ),
            F.when(~F.map_contains_key(ENTRIES(d), "note"), F.create_map(F.lit("note"), F.parse_json(F.lit("0")))).otherwise(
                F.create_map().cast("map<string,variant>")
            ),
        ),
        F.array(*[F.lit(x) for x in ("type", "name", "size", "active", "note")]),
    ),
    source=mixed_doc,
)
conform_query(
    "conf_coerce",
    LINE_SQL + """select _id, l_partkey, l_suppkey, '{"line":["' || 'x' || '"],"flags":["' || l_returnflag || '","' || l_linestatus || '"],"order":"' || l_orderkey || '","charges":' ||
        case n_charges when 0 then '"[]"' when 1 then '{"kind":"' || case when l_discount > 0 then 'discount' else 'tax' end || '","rate":' || greatest(l_discount, l_tax) || '}'
        else '"[{''kind'': ''discount'', ''rate'': ' || l_discount || '}, {''kind'': ''tax'', ''rate'': ' || l_tax || '}]"' end || '}' as doc from line""",
    lambda d: C.restore_param_order(
        F.map_concat(
            C.coerce(
                C.keep_known(ENTRIES(d), C.Spec(("flags", "order", "charges"))),
                C.Spec((), types={"flags": "Sequence[str]", "order": "str", "charges": "str"}),
            ),
            C.coerce(F.create_map(F.lit("line"), F.lit("x").cast("variant")), C.Spec((), types={"line": "List[int] | None"})),
        ),
        F.array(*[F.lit(x) for x in ("line", "flags", "order", "charges")]),
    ),
    source=line_doc, keep=("_id", "l_partkey", "l_suppkey"),
)
conform_query(
    "conf_order",
    EVENT + f"""'{{"user_id":"' || user_id || '","event_type":["' || event_type || '"],"value":"' || value || '","props":{{"k":' || {K} || '}}}}' as doc from events""",
    lambda d: C.conform(d, SPEC, widget=True),
)
conform_query(
    "conf_signature",
    EVENT + f"""'{{"user_id":"' || user_id || '","event_type":["' || event_type || '"],"value":"' || value || '","props":{{"k":' || {K} || '}},"label":"None"}}' as doc from events""",
    lambda d: C.conform(d, SPEC),
)
