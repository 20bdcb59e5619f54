"""Template queries; the flagship ``build_messages`` is at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.template import render
from ..functions.template_filters import custom
from ..operators.messages import build_messages
from .adapters import CONTEXT_SQL, LINE_SQL, MIXED_SQL, context_doc, dealt_line_doc, event_doc, line_doc, mixed_doc, table
from .registry import query


def template_query(name, source, keep, template, sql, prepare=None, **options):
    """``keep`` columns and the rendered ``text`` over a table or an adapter's frame."""

    @query(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        df = prepare(df) if prepare else df
        return render(df, template, **options).select(*keep, "text")


def nations(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def customers(spark, sf_dir):
    """Customers with their nation and region nested as objects."""
    c = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment",
        F.struct(
            F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"),
            F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).alias("region"),
        ).alias("nation"),
        F.array("c_mktsegment", "n_name").alias("tags"),
    )


CUSTOMER_SQL = """
with cust as (select * from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""

template_query(
    "tpl_literal", "customer", ["c_custkey"], "No { markup } here: % } #",
    "select c_custkey, 'No { markup } here: % } #' as text from customer",
)
template_query(
    "tpl_output", customers, ["c_custkey"],
    "{{ c_name }} of {{ nation.name }}/{{ nation['region'].name }} [{{ tags[0] }}, {{ tags[-1] }}] {{ missing }}.",
    CUSTOMER_SQL + "select c_custkey, c_name || ' of ' || n_name || '/' || r_name || ' [' || c_mktsegment || ', ' || n_name || '] .' as text from cust",
)
template_query(
    "tpl_undefined", mixed_doc, ["_id"],
    "{{ v.name }}: {{ v.size.unit }}{{ v.none }}{% for x in nothing %}x{% else %}-{% endfor %}{% if nothing %}y{% endif %}",
    MIXED_SQL + """select _id, case when size_str is null and size_num is null
        then '{{ v.name }}: {{ v.size.unit }}{{ v.none }}{% for x in nothing %}x{% else %}-{% endfor %}{% if nothing %}y{% endif %}'
        else name || ': -' end as text from mixed""",
)
template_query(
    "tpl_if", customers, ["c_custkey"],
    "{% if c_acctbal < 0 %}owes{% elif c_acctbal > 5000 and nation.region.key %}rich{% elif nation.key %}fine{% else %}first{% endif %}",
    CUSTOMER_SQL + """select c_custkey, case when c_acctbal < 0 then 'owes' when c_acctbal > 5000 and r_regionkey <> 0 then 'rich'
        when n_nationkey <> 0 then 'fine' else 'first' end as text from cust""",
)
template_query(
    "tpl_ternary", customers, ["c_custkey"],
    "{{ 'A' if c_mktsegment == 'BUILDING' else c_name }}|{{ 'B' if c_acctbal >= 1000.5 }}|{{ nation.key or 'zero' }}",
    CUSTOMER_SQL + """select c_custkey, case when c_mktsegment = 'BUILDING' then 'A' else c_name end || '|' ||
        case when c_acctbal >= 1000.5 then 'B' else '' end || '|' ||
        case when n_nationkey = 0 then 'zero' else cast(n_nationkey as varchar) end as text from cust""",
)
template_query(
    "tpl_for", line_doc, ["_id", "l_partkey", "l_suppkey"],
    "{% for c in v.charges %}{{ c.kind }}={{ c.rate }};{% else %}free{% endfor %}{% for f in v.flags if f != 'N' %}{{ f }}{% endfor %}",
    LINE_SQL + """select _id, l_partkey, l_suppkey,
        case when n_charges = 0 then 'free' else
          case when l_discount > 0 then 'discount=' || l_discount || ';' else '' end ||
          case when l_tax > 0 then 'tax=' || l_tax || ';' else '' end end ||
        case when l_returnflag <> 'N' then l_returnflag else '' end || l_linestatus as text from line""",
)
template_query(
    "tpl_for_items", event_doc, ["_id"],
    "{% for key, value in d.items() %}{{ key }}{% if not loop.last %}, {% endif %}{% endfor %} {{ d.props.k }}",
    """select cast(event_id as varchar) as _id, 'event_id, user_id, event_type, value, props, ts ' ||
       regexp_extract(props, '[0-9]+') as text from events""",
    prepare=lambda df: df.select("_id", F.from_json("doc", "map<string,variant>").alias("d")),
)
template_query(
    "tpl_loop_vars", line_doc, ["_id", "l_partkey", "l_suppkey"],
    "{% for f in v.flags %}{{ loop.index }}{{ loop.index0 }}{{ loop.revindex }}{{ loop.revindex0 }}"
    "{{ loop.first }}{{ loop.last }}{{ loop.length }}{{ f }} {% endfor %}",
    LINE_SQL + """select _id, l_partkey, l_suppkey,
        '1021TrueFalse2' || l_returnflag || ' 2110FalseTrue2' || l_linestatus || ' ' as text from line""",
)
template_query(
    "tpl_loop_prev", line_doc, ["_id", "l_partkey", "l_suppkey"],
    "{% for f in v.flags %}({{ loop.previtem }}<{{ f }}>{{ loop.nextitem }} {{ loop.cycle('odd', 'even') }} {{ loop.depth }}"
    "{% for c in v.charges %}{{ loop.depth }}{% endfor %}){% endfor %}",
    LINE_SQL + """select _id, l_partkey, l_suppkey,
        '(<' || l_returnflag || '>' || l_linestatus || ' odd 1' || repeat('2', n_charges) || ')(' ||
        l_returnflag || '<' || l_linestatus || '> even 1' || repeat('2', n_charges) || ')' as text from line""",
)
template_query(
    "tpl_tests", mixed_doc, ["_id"],
    "{{ v.size is defined }} {{ v.size is string }} {{ v.size is number }} {{ v.size is integer }} {{ v.size is even }} "
    "{{ v.note is none }} {{ v.active is boolean }} {{ v.active is true }} {{ v.name is sequence }} {{ v is mapping }} "
    "{{ v.type is in(['part', 'x']) }} {{ v.type is eq 'part' }} {{ v.size is undefined }} {{ v.type is lower }} {{ v.name is not upper }}",
    MIXED_SQL + """select _id, (case when size_str is not null or size_num is not null then 'True ' else 'False ' end) ||
        (case when size_str is not null then 'True ' else 'False ' end) ||
        (case when size_num is not null then 'True True ' else 'False False ' end) ||
        (case when size_num % 2 = 0 then 'True ' else 'False ' end) ||
        (case when has_note then 'True ' else 'False ' end) ||
        (case when active is not null then 'True ' else 'False ' end) || (case when active then 'True ' else 'False ' end) ||
        'True True ' || (case when type = 'part' then 'True True ' else 'False False ' end) ||
        (case when size_str is null and size_num is null then 'True ' else 'False ' end) || 'True True' as text from mixed""",
)
template_query(
    "tpl_operators", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "{{ l_partkey + 1 }} {{ l_partkey - l_suppkey }} {{ l_linenumber * 2 }} {{ l_partkey // 7 }} {{ (0 - l_partkey) // 7 }} "
    "{{ (0 - l_partkey) % 7 }} {{ l_linenumber ** 2 }} {{ l_quantity / 2 }} {{ l_linestatus ~ l_linenumber }} "
    "{{ l_quantity > 25 and not l_returnflag == 'N' }} {{ l_returnflag in ['A', 'R'] }} {{ 1 < l_linenumber <= 3 }}",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey + 1) || ' ' || (l_partkey - l_suppkey) || ' ' || (l_linenumber * 2) || ' ' ||
       cast(floor(l_partkey / 7) as bigint) || ' ' || cast(floor(-l_partkey / 7) as bigint) || ' ' ||
       (-l_partkey - 7 * cast(floor(-l_partkey / 7) as bigint)) || ' ' || (l_linenumber * l_linenumber) || ' ' || (l_quantity / 2) || ' ' ||
       l_linestatus || l_linenumber || ' ' || case when l_quantity > 25 and l_returnflag <> 'N' then 'True' else 'False' end || ' ' ||
       case when l_returnflag in ('A', 'R') then 'True' else 'False' end || ' ' ||
       case when l_linenumber in (2, 3) then 'True' else 'False' end as text from lineitem""",
)
template_query(
    "tpl_set_ws", customers, ["c_custkey"],
    "{# a comment #}{% set label = c_name ~ '!' -%}   \n  {{ label }}  {%- if true %} x{% endif %}{% raw %} {{ raw }} {% endraw %}|\n",
    "select c_custkey, c_name || '! x {{ raw }} |' as text from customer",
)


def context_rows(spark, sf_dir):
    return context_doc(spark, sf_dir).select(
        "org_id", "org_context.*", F.lit(1e20).alias("huge"), F.lit(True).alias("flag")
    )


template_query(
    "tpl_text_form", context_rows, ["org_id"],
    "{{ location_operations }} {{ offerings }} {{ terminology_mapping[0] }} {{ flag }} {{ huge }} {{ balance }} {{ [org_description] }}",
    CONTEXT_SQL + """select org_id, '[''' || n_name || ''', '' '', ''' || r_name || '''] ' ||
        case when c_custkey % 2 = 0 then '[''' || c_mktsegment || ''', '' plan ' || n_nationkey || ''']'
             else '{''main'': ''' || c_mktsegment || ''', ''side'': '' for ' || r_name || ''', ''void'': ''  ''}' end ||
        ' {''original'': ''' || n_name || ''', ''replacement'': ''' || r_name || '''} True 1e+20 ' || c_acctbal ||
        ' ["  It''s in ' || n_name || ' \\n"]' as text from ctx""",
)
template_query(
    "tpl_context_precedence", customers, ["c_custkey"],
    "{{ name }} {{ key }} {{ region.name }} {{ c_name }}",
    CUSTOMER_SQL + """select c_custkey, r_name || ' ' || r_regionkey || ' ' || r_name || ' ' || c_name as text from cust""",
)
template_query(
    "tpl_nested", customers, ["c_custkey", "needs_rerender"],
    "{{ system_prompt }}{% if context %} / {{ context }}{% endif %}",
    CUSTOMER_SQL + """select c_custkey, false as needs_rerender,
        'You help ' || c_name || '. / In ' || n_name || ' (' || r_name || ')' as text from cust""",
    variables={
        "system_prompt": "You help {{ c_name }}.",
        "context": "In {{ nation.name }} {{ inner }}",
        "inner": "({{ nation.region.name }})",
    },
)
template_query(
    "tpl_filter_string", "part", ["p_partkey"],
    "{{ p_name | upper }}|{{ p_type | lower | capitalize }}|{{ (p_name ~ '-' ~ p_type) | title }}|{{ p_name | replace(' ', '_') }}|"
    "{{ ('  ' ~ p_brand ~ ' ') | trim }}|{{ ('<b>' ~ p_name ~ '</b> <i/>x') | striptags }}|{{ p_type | center(11) }}|"
    "{{ '%s has %d' | format(p_brand, p_size) }}|{{ 'a quite long sentence' | truncate(12) }}|{{ (p_name ~ ' and more words') | wordwrap(30) | length }}",
    r"""select p_partkey, upper(p_name) || '|' || upper(p_type[1]) || lower(p_type[2:]) || '|' ||
        array_to_string(list_transform(string_split(p_name, ' '), lambda w : upper(w[1]) || w[2:]), ' ') || '-' || upper(p_type[1]) || lower(p_type[2:]) || '|' ||
        replace(p_name, ' ', '_') || '|' || p_brand || '|' || p_name || ' x|' ||
        repeat(' ', cast(floor((11 - length(p_type)) / 2) as bigint) + ((11 - length(p_type)) & 1)) || p_type ||
        repeat(' ', 11 - length(p_type) - cast(floor((11 - length(p_type)) / 2) as bigint) - ((11 - length(p_type)) & 1)) || '|' ||
        p_brand || ' has ' || p_size || '|a quite...|' || (length(p_name) + 15) as text from part""",
)
template_query(
    "tpl_filter_list", dealt_line_doc, ["_id", "l_partkey", "l_suppkey"],
    "{{ v.flags | length }}{{ v.flags | first }}{{ v.flags | last }} {{ v.flags | sort | join('<') }} {{ v.flags | reverse | join }} "
    "{{ (v.flags + ['a', 'A', v.flags[0]]) | unique | list | length }} {{ v.charges | map(attribute='kind') | join('+') }} "
    "{{ v.charges | selectattr('rate', 'gt', 0.04) | list | length }} {{ [3, 1, 2] | sort(reverse=true) | list }} "
    "{{ [1, 2, 3] | batch(2, 0) | list }} {{ [1, 2, 3] | slice(2) | list }} {{ v.flags | select('in', ['A', 'R', 'F']) | list | count }} "
    "{% for g in v.charges | groupby('kind') %}{{ g.grouper }}:{{ g.list | length }};{% endfor %}",
    LINE_SQL + """select _id, l_partkey, l_suppkey, '2' || l_returnflag || l_linestatus || ' ' || least(l_returnflag, l_linestatus) || '<' || greatest(l_returnflag, l_linestatus)
        || ' ' || l_linestatus || l_returnflag || ' ' || (case when l_returnflag = 'A' then 2 else 3 end) || ' ' ||
        concat_ws('+', case when l_discount > 0 then 'discount' end, case when l_tax > 0 then 'tax' end) || ' ' ||
        (case when l_discount > 0.04 then 1 else 0 end + case when l_tax > 0.04 then 1 else 0 end) || ' [3, 2, 1] [[1, 2], [3, 0]] [[1, 2], [3]] ' ||
        (case when l_returnflag in ('A', 'R') then 1 else 0 end + case when l_linestatus = 'F' then 1 else 0 end) || ' ' ||
        case when l_discount > 0 then 'discount:1;' else '' end || case when l_tax > 0 then 'tax:1;' else '' end as text from line""",
    prepare=lambda df: df.withColumn(
        "v",
        F.struct(
            F.array(F.try_variant_get("v", "$.flags[0]", "string"), F.try_variant_get("v", "$.flags[1]", "string")).alias("flags"),
            F.try_variant_get("v", "$.charges", "array<struct<kind:string,rate:double>>").alias("charges"),
        ),
    ).drop("doc"),
)
template_query(
    "tpl_filter_number", "customer", ["c_custkey"],
    "{{ c_acctbal | abs }} {{ c_custkey | float }} {{ c_name[9:] | int }}".replace("c_name[9:]", "(c_name | replace('Customer#', ''))")
    + " {{ '42.5' | int }} {{ c_name | int(7) }} {{ '3.5' | float }} {{ c_acctbal | int }} {{ (c_custkey / 2) | round | int }} {{ c_acctbal | round(0, 'floor') }}",
    """select c_custkey, abs(c_acctbal) || ' ' || cast(c_custkey as double) || ' ' || c_custkey || ' 42 7 3.5 ' || cast(trunc(c_acctbal) as bigint) || ' ' ||
       cast(round_even(c_custkey / 2.0, 0) as bigint) || ' ' || cast(floor(c_acctbal) as double) as text from customer""",
)
template_query(
    "tpl_filter_default", mixed_doc, ["_id"],
    "{{ v.size | default('none') }}|{{ v.size.unit | default('no unit') }}|{{ '' | default('empty', true) }}|{{ v.note | default('gone') }}|"
    "{{ (v.name ~ '<&>') | e }}|{{ ('<' ~ v.type) | safe }}|{{ v.nation | string }}",
    MIXED_SQL + """select _id, coalesce(size_str, cast(size_num as varchar), 'none') || '|no unit|empty|' || case when has_note then 'None' else 'gone' end || '|' ||
        name || '&lt;&amp;&gt;|<' || type || '|' || coalesce(cast(nation as varchar), '') as text from mixed""",
)
template_query(
    "tpl_filter_json", event_doc, ["_id"],
    "{{ v.props | tojson }} {{ v.event_type | tojson }} {% for k, x in v.props | items %}{{ k }}{{ x }}{% endfor %} {{ v.props | dictsort }} {{ {'b': 1, 'a': '<é'} | tojson }}",
    """select cast(event_id as varchar) as _id, '{"k": ' || k || '} "' || event_type || '" k' || k || ' [(''k'', ' || k || ')] {"a": "\\u003c\\u00e9", "b": 1}' as text
       from (select *, regexp_extract(props, '[0-9]+') as k from events)""",
)
template_query(
    "udf_filter", "part", ["p_partkey"], "{{ p_name | initials }} {{ p_brand | upper | spaced('-') }}",
    """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w : w[1]), '') || ' ' ||
       array_to_string(string_split(upper(p_brand), ''), '-') as text from part""",
    filters={
        "initials": custom(lambda s: F.array_join(F.transform(F.split(s, " "), lambda w: F.substring(w, 1, 1)), "")),
        "spaced": custom(lambda s, sep: F.concat_ws("-", F.filter(F.split(s, ""), lambda c: c != ""))),
    },
)

# The system prompt is itself a template, as in stored system templates.
SYSTEM_PROMPT = "You advise {{ client_name }} ({{ segment | lower | title }})."
CONTEXT = "{% if org_name %}Organization Name: {{ org_name }}\n{% endif %}{% for place in places %}{% if loop.first %}Places:{% endif %} {{ place }}{% endfor %}"


@query(
    "build_messages",
    """select o_orderkey,
              'You advise ' || c_name || ' (' || c_mktsegment[1] || lower(c_mktsegment[2:]) || ').' || chr(10) || chr(10) || 'Context:' || chr(10) ||
              'Organization Name: ' || n_name || chr(10) || 'Places: ' || n_name || ' ' || r_name ||
              case when r_regionkey > 0 then chr(10) || chr(10) || 'Output Language: ' || r_name else '' end as system_message,
              chr(10) || 'Order Status: ' || o_orderstatus || chr(10) || 'Total: ' || o_totalprice ||
              case when o_orderpriority like '1%' then chr(10) || 'Ship-Now: yes' else '' end as user_message
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
)
def build(spark, sf_dir):
    """Customer, nation and order joined, and both prompt messages rendered per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = nations(spark, sf_dir)
    docs = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.col("c_name").alias("client_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("org_name"),
            F.array("n_name", "r_name").alias("places"),
            F.when(F.col("r_regionkey") > 0, F.col("r_name")).alias("language"),
            F.create_map(
                F.lit("order_status"), F.col("o_orderstatus"),
                F.lit("total"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string"),
                F.lit("ship-now"), F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise(""),
            ).alias("user_context"),
        )
    )
    built = build_messages(docs, variables={"system_prompt": SYSTEM_PROMPT, "context": CONTEXT})
    return built.select(
        "o_orderkey",
        F.col("messages")[0]["content"].alias("system_message"),
        F.col("messages")[1]["content"].alias("user_message"),
    )
