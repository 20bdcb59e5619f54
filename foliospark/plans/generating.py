"""Block parsing, envelopes, generation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import config_array, extract_blocks, parse_configs
from ..functions.jsonschema import validate
from ..operators import envelope as E
from ..operators import generation as G
from ..operators import messages as M
from ..operators.stats import chunked_running
from ..session import scratch
from ..sources.objects import data_url
from .adapters import table
from .registry import query


def yaml_text(spark, sf_dir):
    """Generated text of every shape: fenced, separated, bare, repaired, prose, broken."""
    o = table(spark, sf_dir, "orders")
    k, s, p = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    key, status = F.concat(F.lit("key: "), k), F.concat(F.lit("status: "), s)
    shapes = [
        F.concat(F.lit("---\n"), key, F.lit("\n"), status, F.lit("\n---\n")),
        F.concat(key, F.lit("\n-----  \n"), status, F.lit("\nlevel: '"), p, F.lit("'\n")),
        F.concat(F.lit("  "), key, F.lit("\n")),
        F.concat(F.lit("outer:\n  note one: "), s, F.lit("\n  bad: a: b\n")),
        F.concat(F.lit("just prose about "), k),
        F.concat(F.lit("a: [1, 2\n---\n"), status),
    ]
    text = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        text = F.when(F.col("o_orderkey") % 6 == i, shape).otherwise(text)
    return o.select("o_orderkey", text.alias("content"))


YAML_SQL = """
with y as (select o_orderkey, o_orderkey % 6 as shape, 'key: ' || o_orderkey as k, 'status: ' || o_orderstatus as s, o_orderstatus, o_orderpriority from orders)
"""


@query(
    "extract_blocks",
    YAML_SQL + """select o_orderkey, case shape when 0 then k || chr(10) || s
         when 1 then k || '|' || s || chr(10) || 'level: ''' || o_orderpriority || '''' when 5 then 'a: [1, 2|' || s else '' end as blocks from y""",
)
def extract(spark, sf_dir):
    blocks = extract_blocks(F.col("content"), fallback_to_full=False)
    return yaml_text(spark, sf_dir).select("o_orderkey", F.array_join(blocks, "|").alias("blocks"))


@query(
    "extract_blocks_fallback",
    r"""select doc_id, cast(1 as integer) as n_blocks, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') as block from documents""",
)
def extract_fallback(spark, sf_dir):
    """No document has a delimiter line: every whole text is one block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", extract_blocks(F.col("text"), delimiter="={3,}").alias("found"))
    # a blank text leaves no block; as a whole it is one empty text
    docs = docs.withColumn("found", F.when(F.size("found") == 0, F.array(F.lit(""))).otherwise(F.col("found")))
    return docs.select("doc_id", F.size("found").alias("n_blocks"), F.get("found", F.lit(0)).alias("block"))


CONFIG_ROWS = YAML_SQL + """, configs as (
  select o_orderkey, 0 as block, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' as config from y where shape = 0
  union all select o_orderkey, 0, '{"key":' || o_orderkey || '}' from y where shape in (1, 2)
  union all select o_orderkey, 1, '{"level":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' from y where shape = 1
  union all select o_orderkey, 1, '{"status":"' || o_orderstatus || '"}' from y where shape = 5)
"""


def configs(spark, sf_dir, **options):
    rows = parse_configs(yaml_text(spark, sf_dir), "content", ["o_orderkey"], **options)
    return rows.withColumn("config", F.to_json(F.parse_json("config")))


@query(
    "parse_configs",
    CONFIG_ROWS + "select o_orderkey, count(*) as n_configs, string_agg(config, '|' order by block) as configs from configs group by 1",
)
def parse(spark, sf_dir):
    lists = config_array(configs(spark, sf_dir), ["o_orderkey"])
    return lists.select("o_orderkey", F.col("n_configs").cast("bigint").alias("n_configs"), F.array_join("configs", "|").alias("configs"))


@query(
    "parse_configs_stream",
    YAML_SQL + """select o_orderkey, cast(0 as integer) as position, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' as config from y where shape = 0
       union all select o_orderkey, 0, '{"key":' || o_orderkey || '}' from y where shape = 2""",
)
def parse_stream(spark, sf_dir):
    """The text as one YAML stream; a five-dash line is no separator there."""
    return configs(spark, sf_dir, extract_delimited=False).select("o_orderkey", "position", "config")


@query("config_rows", CONFIG_ROWS + "select o_orderkey, cast(block as integer) as block, config from configs")
def config_rows(spark, sf_dir):
    return configs(spark, sf_dir).select("o_orderkey", "block", "config")


@query(
    "gen_results",
    CONFIG_ROWS + """select o_orderkey, cast(block + 1 as bigint) as iteration, config,
        case when config like '%level%' then 'level: value ''' || o_orderpriority || ''' is not of type integer' else '-' end as error,
        cast(sum(length(config)) over (partition by o_orderkey order by block) as bigint) as running_size
        from configs join orders using (o_orderkey)""",
)
def gen_results(spark, sf_dir):
    """Parsed configs, validated, numbered per text with a running size."""
    rows = configs(spark, sf_dir)
    checked = rows.withColumn("r", validate(F.parse_json("config"), {"properties": {"level": {"type": "integer"}}}))
    checked = checked.select("o_orderkey", "block", "config", F.coalesce("r.error", F.lit("-")).alias("error"))
    sized = chunked_running(
        checked, ["o_orderkey"], ["block"], F.floor(F.col("block") / 64), {"running_size": F.length("config").cast("bigint")}
    )
    return sized.select("o_orderkey", (F.col("block") + 1).cast("bigint").alias("iteration"), "config", "error", "running_size")


# -- envelopes ----------------------------------------------------------------
PACK = ["event_id", "event_type", "value"]


def packed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return E.to_envelope(e, PACK, "user_id", F.col("event_id"), size=1000)


@query(
    "env_pack",
    """select user_id, event_id // 1000 as part, count(*) as n_rows, min(event_id) as first_id, max(event_id) as last_id,
              '["event_id","event_type","value"]' as fields, count_if(event_type = 'error') as n_null from events group by 1, 2""",
)
def env_pack(spark, sf_dir):
    p = F.col("payload")
    values = F.from_json(p, E.ENVELOPE)["input_data"][0]["values"]
    return packed(spark, sf_dir).select(
        "user_id", "part", F.size(values).cast("bigint").alias("n_rows"),
        F.get_json_object(p, "$.input_data[0].values[0][0]").cast("bigint").alias("first_id"),
        F.try_variant_get(F.element_at(values, -1)[0], "$", "bigint").alias("last_id"),
        F.get_json_object(p, "$.input_data[0].fields").alias("fields"),
        F.size(F.filter(values, lambda v: F.is_variant_null(v[2]))).cast("bigint").alias("n_null"),
    )


@query(
    "env_unpack",
    """select user_id, event_id, event_type, case when event_type <> 'error' then value end as value from events""",
)
def env_unpack(spark, sf_dir):
    rows = E.from_envelope(packed(spark, sf_dir), "payload", ["user_id"])
    get = lambda k, t: F.try_variant_get(F.col("params")[k], "$", t).alias(k)
    return rows.select("user_id", get("event_id", "bigint"), get("event_type", "string"), get("value", "double"))


@query(
    "env_record",
    """select c_custkey, case when c_acctbal < 0 then '{"input_data":[{"fields":["c_name"],"values":[["' || c_name || '"]]}]}'
              else '{"input_data":[{"fields":["c_name","c_mktsegment"],"values":[["' || c_name || '","' || c_mktsegment || '"]]}]}' end as payload
       from customer""",
)
def env_record(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return E.record_envelope(c, ["c_name", "c_mktsegment"], ["c_custkey"])


@query(
    "env_prediction",
    """select event_id, case when event_type in ('error', 'signup') then '-' when event_type = 'view' then '{}' else '{"user":' || user_id || '}' end as result,
              case event_type when 'error' then 'failed' when 'signup' then 'unexpected response structure' else '-' end as error,
              case when event_type = 'click' then '["a"]' else '-' end as debug_logs
       from events""",
)
def env_prediction(spark, sf_dir):
    """Errors, malformed responses, and responses without the result key."""
    kind = F.col("event_type")
    body = (
        F.when(kind == "error", F.lit('"fields":["status","error"],"values":[["error","failed"]]'))
        .when(kind == "signup", F.lit('"fields":["out"]'))
        .when(kind == "view", F.lit('"fields":["other"],"values":[[1]]'))
        .when(kind == "click", F.format_string('"fields":["out","debug_logs"],"values":[[{"user":%d},["a"]]]', "user_id"))
        .otherwise(F.format_string('"fields":["out"],"values":[[{"user":%d}],[0]]', "user_id"))
    )
    response = F.concat(F.lit('{"predictions":[{'), body, F.lit("}]}"))
    r = table(spark, sf_dir, "events").select("event_id", E.unpack_prediction(response, "out").alias("r"))
    return r.select("event_id", *[F.coalesce(f"r.{c}", F.lit("-")).alias(c) for c in ("result", "error", "debug_logs")])


# -- generation ---------------------------------------------------------------
def user_turns(spark, sf_dir):
    """Every user turn starts a generation document of its own."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("conv "), F.col("conv_id")).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    return c.select("conv_id", "turn", F.array(system, user).alias("messages"))


def stub(messages):
    """Deterministic: stops for some texts, sends no choices for others."""
    asked, size = len([m for m in messages if m["role"] == "user"]), len(messages[1]["content"])
    if asked == 3 and size % 5 == 0:
        return None
    if asked == 2 and size % 7 == 0:
        return {"choices": [], "usage": {}}
    reply = f"round {asked} of {size}; last {messages[-1]['content']}"
    return {
        "choices": [{"message": {"role": "assistant", "content": reply}}],
        "usage": {"prompt_tokens": len(messages), "completion_tokens": asked, "total_tokens": len(messages) + asked},
    }


ROUNDS_SQL = """
with u as (select conv_id, turn, text, length(text) as size from conversations where role = 'user'),
g as (select conv_id, turn, 1 as round, 'round 1 of ' || size || '; last ' || text as content from u
      union all select conv_id, turn, 2, case when size % 7 <> 0 then 'round 2 of ' || size || '; last Generate Next Output.' end from u
      union all select conv_id, turn, 3, 'round 3 of ' || size || '; last Generate Next Output.' from u where size % 7 <> 0 and size % 5 <> 0)
"""


@query("gen_rounds", ROUNDS_SQL + "select conv_id, turn, cast(round as integer) as round, coalesce(content, '-') as content, case when content is null then 0 else 2 * round + round + 0 end as total from g".replace("2 * round + round + 0", "3 * round"))
def gen_rounds(spark, sf_dir):
    """A null result ends the loop silently, one without choices is kept and ends it."""
    out = G.generate(user_turns(spark, sf_dir), stub, 3, ["conv_id", "turn"])
    total = F.coalesce(G.response_usage(F.col("response"))["total_tokens"], F.lit(0)).cast("int")
    return out.select("conv_id", "turn", "round", F.coalesce("content", F.lit("-")).alias("content"), total.alias("total"))


def echo(messages):
    """Deterministic: a third of the conversations stop after the first answer."""
    asked = len([m for m in messages if m["role"] == "user"])
    if asked > 1 and len(messages[0]["content"]) % 3 == 0:
        return None
    return {"choices": [{"message": {"role": "assistant", "content": f"{asked}: {messages[0]['content'][:20]}"}}]}


@query(
    "gen_stored",
    """select conv_id, turn, cast(round as integer) as round, round || ': ' || text[:20] as content, case when round = 2 then 'heard ' || (2 * round) else '-' end as error
       from conversations, (select unnest([1, 2, 3]) as round) where round = 1 or length(text) % 3 <> 0""",
)
def gen_stored(spark, sf_dir):
    """All turns of all conversations; a repeated call goes on behind the rounds that are written."""
    c = table(spark, sf_dir, "conversations")
    asked = c.select("conv_id", "turn", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    store = scratch(spark, "generated")
    G.generate(asked, echo, 1, ["conv_id", "turn"], on_iteration=heard, store=store)
    out = G.generate(asked, echo, 3, ["conv_id", "turn"], on_iteration=heard, store=store)
    return out.select("conv_id", "turn", "round", "content", F.coalesce("error", F.lit("-")).alias("error"))


def heard(number, result, messages):
    if number == 1:
        raise ValueError(f"heard {len(messages)}")


@query(
    "gen_transcript",
    """select conv_id, turn, 'conv ' || conv_id || '|' || text || '|re: ' || text || '|' || upper(role) as transcript from conversations""",
)
def gen_transcript(spark, sf_dir):
    """Initial messages, then assistant messages; the continuation between them is omitted."""
    c = table(spark, sf_dir, "conversations")
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    initial = F.array(m("system", F.concat(F.lit("conv "), F.col("conv_id"))), m("user", F.col("text")))
    later = F.array(
        m("assistant", F.concat(F.lit("re: "), "text")), m("user", F.lit(M.NEXT_MESSAGE)), m("assistant", F.upper("role"))
    )
    transcript = M.rebuild_transcript(initial, later)
    return c.select("conv_id", "turn", F.array_join(F.transform(transcript, lambda x: x["content"]), "|").alias("transcript"))


@query(
    "gen_init",
    """select cast(conv_id as varchar) || '-' || turn as iteration_id, cast(5 as integer) as iteration_length, role as language, cast(2 as bigint) as n_messages, 'Generate Next Output.' as next_text,
              cast(0 as bigint) as total_tokens, cast(0 as bigint) as n_results, true as dated from conversations""",
)
def gen_init(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("iteration_id"), F.col("conv_id").alias("user_id"), F.lit("org").alias("org_id"),
        F.lit("set").alias("parameter_set_name"), F.col("role").alias("system_template_name"), F.col("role").alias("language"),
        F.create_map(F.lit("topic"), F.col("text")).alias("user_context"),
    )
    g = F.col("generation_content")
    return G.init_iterations(c).select(
        "iteration_id", "iteration_length", "language",
        F.json_array_length(g["messages"]).cast("bigint").alias("n_messages"),
        F.get_json_object("next_question_user_message", "$.content[0].text").alias("next_text"),
        g["metadata"]["total_tokens"].alias("total_tokens"),
        F.size(g["results"]).cast("bigint").alias("n_results"),
        g["metadata"]["created_at"].rlike(r"^\d{4}-\d\d-\d\dT").alias("dated"),
    )


@query(
    "gen_examples",
    """select page_id, 'user|assistant' as roles, 'Read this.' as instruction, 'data:image/png;base64,' || to_base64(encode(html)) as image, url as answer from pages""",
)
def gen_examples(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    image = data_url(F.format_string("%d.png", "page_id"), F.col("html").cast("binary"))
    pairs = p.select("page_id", M.example_pair(F.lit("Read this."), image, F.col("url")).alias("m"))
    return pairs.select(
        "page_id", F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("roles"),
        F.try_variant_get(F.col("m")[0]["content"], "$[0].text", "string").alias("instruction"),
        F.try_variant_get(F.col("m")[0]["content"], "$[1].image_url.url", "string").alias("image"),
        F.try_variant_get(F.col("m")[1]["content"], "$", "string").alias("answer"),
    )


@query(
    "msg_parts",
    """select conv_id, turn, cast(0 as integer) as position, 'text' as part_type, text as text, '' as image_url from conversations
       union all select conv_id, turn, 1, 'image_url', '', 'http://x/' || turn from conversations where role = 'assistant'""",
)
def msg_parts(spark, sf_dir):
    """Assistant turns as a list of parts, the others as plain text."""
    c = table(spark, sf_dir, "conversations")
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("http://x/"), "turn").alias("url")).alias("image_url")),
    )
    content = F.when(F.col("role") == "assistant", F.parse_json(F.to_json(parts))).otherwise(F.col("text").cast("variant"))
    rows = M.explode_parts(c.withColumn("content", content), "content", ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "position", "part_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("image_url", F.lit("")).alias("image_url"))


# -- user functions -----------------------------------------------------------
def score_event(payload):
    row = dict(zip(payload["input_data"][0]["fields"], payload["input_data"][0]["values"][0]))
    if row["event_type"] == "error":
        return {"predictions": [{"fields": ["status", "error"], "values": [["error", "no score"]]}]}
    return {"predictions": [{"fields": ["score"], "values": [[row["user_id"] * 2]]}]}


@query(
    "udf_score",
    """select event_id, case when event_type = 'error' then '-' else cast(user_id * 2 as varchar) end as score,
              case when event_type = 'error' then 'no score' else '-' end as error from events""",
)
def udf_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    requests = E.record_envelope(e, ["user_id", "event_type"], ["event_id"])
    scored = G.score_records(requests, score_event, "payload", ["event_id"])
    r = scored.select("event_id", E.unpack_prediction(F.col("response"), "score").alias("r"))
    return r.select("event_id", F.coalesce("r.result", F.lit("-")).alias("score"), F.coalesce("r.error", F.lit("-")).alias("error"))


def picky_hook(round_index, result, messages):
    if round_index == 1:
        raise ValueError(f"refused after {len(messages)} messages")


@query(
    "udf_callback",
    ROUNDS_SQL + """select conv_id, turn, cast(round as integer) as round, case when round = 2 and content is not null then 'refused after 5 messages' else '-' end as error from g""",
)
def udf_callback(spark, sf_dir):
    """The hook fails in round 2; the loop goes on and the failure is recorded."""
    out = G.generate(user_turns(spark, sf_dir), stub, 3, ["conv_id", "turn"], on_iteration=picky_hook)
    return out.select("conv_id", "turn", "round", F.coalesce("error", F.lit("-")).alias("error"))
