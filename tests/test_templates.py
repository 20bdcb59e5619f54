"""Templates: worked examples with literal results."""

import pytest

from foliospark.functions.template import TemplateError, compile_template, render, scope_of

ROW = """select 'foo' as name, 5 as n, 2.5D as x, true as flag, array(3,1,2) as nums, array('b','A','c','a') as strs,
 named_struct('a',1,'b','two') as obj, map('k1','v1','k2','v2') as m,
 parse_json('{"z":[1,2.0,"q\\'s"],"a":{"b":null,"t":true}}') as v,
 array(named_struct('name','x','active',true,'city','P'),named_struct('name','y','active',false,'city','p')) as users,
 cast(null as string) as nul"""

# fmt: off
CASES = [("{{ 'hello' | upper }}","HELLO"),("{{ 'hello world' | title }}","Hello World"),("{{ 'foo-bar (baz <q' | title }}","Foo-Bar (Baz <Q"),
("{{ '  hi  ' | trim }}|","hi|"),("{{ '<p>hi</p>' | striptags }}","hi"),("{{ 'hello' | replace('l','x') }}","hexxo"),
("{{ 'hello world' | truncate(5) }}","he..."),("{{ 'hello big wide world' | truncate(12) }}","hello..."),("{{ 'hi'|center(10) }}|","    hi    |"),
("{{ 'hi'|center(5) }}|","  hi |"),
("{{ '%s - %d'|format('hi',5) }}","hi - 5"),("{{ [1,2,3]|length }}","3"),("{{ [1,2,3]|first }}{{ [1,2,3]|last }}","13"),
("{{ [1,2,3]|reverse|list }}","[3, 2, 1]"),("{{ nums|sort }}{{ nums|sort(reverse=true) }}","[1, 2, 3][3, 2, 1]"),("{{ [1,1,2]|unique|list }}","[1, 2]"),
("{{ strs|sort }}{{ strs|unique|list }}","['A', 'a', 'b', 'c']['b', 'A', 'c']"),("{{ [1,2,3]|join(', ') }}","1, 2, 3"),("{{ 'abc'|list }}","['a', 'b', 'c']"),
("{{ [1,2,3,4,5]|batch(2)|list }}","[[1, 2], [3, 4], [5]]"),("{{ [1,2,3,4,5]|slice(2)|list }}","[[1, 2, 3], [4, 5]]"),
("{{ users|map(attribute='name')|list }}","['x', 'y']"),("{{ [1,2,3,4]|select('even')|list }}{{ [1,2,3,4]|reject('even')|list }}","[2, 4][1, 3]"),
("{{ users|selectattr('active')|map(attribute='name')|join(', ') }}","x"),("{% for c, l in users|groupby('city') %}{{c}}:{{l|length}};{% endfor %}","P:2;"),
("{{ -5|abs }}","5"),("{{ (-5)|abs }}","5"),("{{ 3.14159|round(2) }}","3.14"),("{{ '42'|int }}{{ '42.5'|int }}{{ 'q'|int }}","42420"),("{{ '3.14'|float }}","3.14"),
("{{ zz|default('N/A') }}","N/A"),("{{ ''|default('empty',true) }}","empty"),("{{ '<a&\"'|e }}","&lt;a&amp;&#34;"),("{{ v|tojson }}",'{"a": {"b": null, "t": true}, "z": [1, 2.0, "q\\u0027s"]}'),
("{{ v }}","{'a': {'b': None, 't': True}, 'z': [1, 2.0, \"q's\"]}"),("{{ m }}","{'k1': 'v1', 'k2': 'v2'}"),("{{ obj }}","{'a': 1, 'b': 'two'}"),
("{{ flag }} {{ x }} {{ 7/2 }} {{ 7//2 }} {{ -7//2 }} {{ -7 % 3 }} {{ 2**10 }} {{ 2**-1 }}","True 2.5 3.5 3 -4 2 1024 0.5"),("{{ 1e22 }} {{ 1234567.0*100 }} {{ 0.00001 }} {{ 0.0001 }} {{ 1.25e-7 }} {{ 1.25e+105 }}","1e+22 123456700.0 1e-05 0.0001 1.25e-07 1.25e+105"),
("{{ zz }}|","|"),("{{ zz.a }}|","{{ zz.a }}|"),("{% if zz %}a{% else %}b{% endif %}","b"),("{% for i in zz %}x{% else %}none{% endfor %}","none"),
("{% for i in nums %}{{ loop.index }}{{ loop.revindex0 }}{{ loop.first }}{{ loop.previtem }}{{ loop.cycle('o','e') }}{% if not loop.last %},{% endif %}{% endfor %}","12Trueo,21False3e,30False1o"),
("{% for k,v in m.items() %}{{ k|title }}={{ v }} {% endfor %}","K1=v1 K2=v2 "),("{%- set q = n + 1 -%}  {{ q }}","6"),("{% raw %}{{ x }}{% endraw %}","{{ x }}"),("{{ 1 }}a {#- c -#} b\n","1ab"),
("{{ 'a' if n > 3 else 'b' }}{{ 'a' if n > 9 }}","a"),("{{ name ~ n ~ x }}","foo52.5"),("{{ v is mapping }}{{ n is number }}{{ n is integer }}{{ flag is number }}{{ flag is integer }}{{ name is sequence }}","TrueTrueTrueTrueFalseTrue"),
("{{ v.a.b is none }}{{ v.q is defined }}{{ v.z[1] }}{{ v.z[-1] }}{{ v['a']['t'] }}","TrueFalse2.0q'sTrue"),("{{ 2 in nums }}{{ 'o' in name }}{{ 'k1' in m }}{{ 9 not in nums }}","TrueTrueTrueTrue"),
("{% if n is divisibleby 5 and name is lower %}y{% endif %}","y"),("{{ zz or name }}{{ n and x }}{{ 0 or '' }}|","foo2.5|"),("{{ 1 < n <= 5 }}","True"),("{{ ['it\\'s','a\"b'] }}","[\"it's\", 'a\"b']"),
("{{ m|dictsort(reverse=true) }}","[('k2', 'v2'), ('k1', 'v1')]"),("{{ {'a': 1, 'b': [1,'x']} }}","{'a': 1, 'b': [1, 'x']}"),("{{ 'the quick brown fox-trot jumped'|wordwrap(10) }}","the quick\nbrown fox-\ntrot\njumped"),
("{{ 'ab abcdefghijkl'|wordwrap(5) }}","ab ab\ncdefg\nhijkl"),("{% set ns = 1 %}{% if flag %}{% set ns = 'two' %}{% endif %}{{ ns }}","two"),("{{ nul }}|{{ nul is defined }}","|False"),("{% for i in range(3) -%} {{ i }} {%- endfor %}","012"),
("{% for a in nums if a > 1 %}{{ a }}{{ loop.length }}{% endfor %}","3222"),("{{ 10|string + 'x' }}","10x"),("{{ zz.a if zz else 'ok' }}","ok"),("{{ zz.a|default('d') }}","d"),("{{ loop }}|","|"),("{{ 'é' | tojson }}",'"\\u00e9"')]
# fmt: on


def test_worked_examples(spark):
    df = spark.sql(ROW)
    scope = scope_of(df)
    wrong = []
    for at in range(0, len(CASES), 20):
        part = CASES[at : at + 20]
        row = df.select(*[compile_template(t, scope).alias(f"c{i}") for i, (t, _) in enumerate(part)]).first()
        wrong += [(t, got, want) for (t, want), got in zip(part, row) if got != want]
    assert not wrong


@pytest.mark.parametrize("bad", ["{% if a %}x", "{{ a | nothing }}", "{% macro f() %}{% endmacro %}", "{{ a.b( }}"])
def test_bad_templates_fail_at_once(spark, bad):
    with pytest.raises((TemplateError, IndexError)):
        compile_template(bad, scope_of(spark.sql(ROW)))


def test_cycle_is_an_error(spark):
    with pytest.raises(TemplateError, match="refer to each other"):
        compile_template("{{ a }}", scope_of(spark.sql(ROW)), {"a": "{{ b }}", "b": "{{ a }}"})


def test_data_is_never_rendered(spark):
    df = spark.sql("select '{{ n }}' as s, 3 as n")
    row = render(df, "{{ s }}").first()
    assert row["text"] == "{{ n }}" and row["needs_rerender"]


def test_rendering_stays_native(spark):
    plan = render(spark.range(5), "{% for i in range(3) %}{{ i * id }}{% endfor %}")._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_lines_of_one_row_group_are_rendered_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from foliospark.plans.registry import load_all

    line = "id as l_orderkey, 1 as l_linenumber, id % 7 as l_partkey, id % 3 as l_suppkey, 'A' as l_returnflag, 'F' as l_linestatus, " \
        "0.05D as l_discount, 0D as l_tax, 2D as l_quantity, 3D as l_extendedprice"
    spark.range(0, 400, 1, 1).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = load_all()[0]["tpl_filter_list"](spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    rows = out.groupBy("text").count().collect()
    assert [tuple(r) for r in rows] == [("2AF A<F FA 2 discount 1 [3, 2, 1] [[1, 2], [3, 0]] [[1, 2], [3]] 2 discount:1;", 400)]


def test_a_list_is_made_once_for_its_length(spark):
    df = spark.sql("select array('b', 'A', 'a') as strs, cast(null as array<string>) as a, cast(null as map<string,int>) as m, cast(null as string) as s")
    out = render(df, "{{ strs | unique | length }}{{ a | length }}{{ m | length }}{{ s | length }}").select("text")
    assert out.first()[0] == "2000"
    assert out._jdf.queryExecution().analyzed().toString().count("array_position") == 1


def test_filters_over_literals_are_worked_out_once(spark):
    template = "{{ [3, 1, 2] | sort(reverse=true) | list }}{{ [n, 1] | sort | list }}"
    out = render(spark.sql("select 2 as n"), template).select("text")
    assert out.first()[0] == "[3, 2, 1][1, 2]"
    assert out._jdf.queryExecution().analyzed().toString().count("sort_array") == 1
    custom = {"sort": lambda _, v: v}  # a user's own filter is left alone
    assert render(spark.sql("select 2 as n"), "{{ [3, 1] | sort | list }}", filters=custom).first()["text"] == "[3, 1]"
