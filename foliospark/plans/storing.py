"""Sources, sinks and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.selector import where
from ..operators import updates as U
from ..operators.stats import collect_messages
from ..session import scratch
from ..sources import buckets as L
from ..sources import documents as D
from ..sources import objects as B
from .adapters import TURNS_SQL, event_doc, mixed_doc, table, turns
from .registry import query

FILE_ROWS = 500  # documents per written JSON file; ids are dense, so files stay this small


def event_files(spark, sf_dir, base):
    """The events as JSON files, each a list of at most ``FILE_ROWS`` documents."""
    e = event_doc(spark, sf_dir)
    block = F.floor(F.col("_id").cast("bigint") / FILE_ROWS)
    lists = e.groupBy(block.alias("block")).agg(F.collect_list("doc").alias("docs"))
    content = F.concat(F.lit("[\n"), F.array_join("docs", ",\n"), F.lit("\n]"))
    good = lists.select(F.format_string("list-%d.json", "block").alias("key"), content.alias("content"))
    bad = lists.select(F.format_string("broken-%d.json", "block").alias("key"), F.lit('{"a":').alias("content"))
    marked = lists.select(F.format_string("x_corrupted-%d.json", "block").alias("key"), F.lit("{}").alias("content"))
    other = lists.select(F.format_string("note-%d.txt", "block").alias("key"), F.lit("{}").alias("content"))
    B.put_objects(good.unionByName(bad).unionByName(marked).unionByName(other), base).count()


EVENT_BLOCKS = f"select distinct event_id // {FILE_ROWS} as block from events"


@query(
    "src_json_docs",
    f"""select 'event' as kind, event_id as id from events
        union all select 'reject', block from ({EVENT_BLOCKS})""",
)
def src_json_docs(spark, sf_dir):
    """Every file one document; broken files are reported, marked ones skipped."""
    base = scratch(spark, "json")
    event_files(spark, sf_dir, base)
    docs, rejects = D.read_json_documents(spark, base)
    events = docs.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    return events.select(
        F.lit("event").alias("kind"), F.variant_get("e", "$.event_id", "bigint").alias("id")
    ).unionByName(
        rejects.select(
            F.lit("reject").alias("kind"), F.regexp_extract("file", r"broken-(\d+)", 1).cast("bigint").alias("id")
        )
    )


@query(
    "src_json_mapping",
    f"""select 'folder' as collection, cast(count(*) as bigint) as n, cast(null as bigint) as last from ({EVENT_BLOCKS})
        union all select 'files', count(*), max(event_id) from events""",
)
def src_json_mapping(spark, sf_dir):
    """A folder gives one document per file, named files give one per list element."""
    base = scratch(spark, "mapping")
    event_files(spark, sf_dir, base)
    mapping = {"folder": [base], "files": [f"{base}/*.json", f"{base}/absent.json"], "none": [f"{base}/no"]}
    docs = D.read_json_mapping(spark, mapping)
    last = F.try_variant_get("v", "$.event_id", "bigint")
    return docs.groupBy("collection").agg(F.count("*").alias("n"), F.max(last).alias("last"))


@query(
    "src_raw_lists",
    """select event_id, '{"z": ' || event_id || '.50, "a": {"k": 1.0, "b": [2, {}]}}' as doc from events""",
)
def src_raw_lists(spark, sf_dir):
    """Elements of a list file keep the order of their keys and the spelling of their numbers."""
    base = scratch(spark, "lists")
    e = table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / FILE_ROWS))
    one = F.concat(F.lit('{"z": '), "event_id", F.lit('.50, "a": {"k": 1.0, "b": [2, {}]}}'))
    lists = e.groupBy("block").agg(F.concat(F.lit("[ "), F.array_join(F.collect_list(one), " ,"), F.lit("]")).alias("content"))
    B.put_objects(lists.select(F.concat(F.col("block").cast("string"), F.lit(".json")).alias("key"), "content"), base).count()
    docs = D.read_json_mapping(spark, {"files": [f"{base}/*.json"]})
    return docs.select(F.floor(F.try_variant_get("v", "$.z", "double")).alias("event_id"), "doc")


@query(
    "src_folder_tree",
    """select 'c_' || lower(o_orderpriority[1:1]) as collection, o_orderstatus as status, count(*) as n
       from orders where o_orderpriority <> '5-LOW' group by all""",
)
def src_folder_tree(spark, sf_dir):
    """Folders become collections; an unmapped folder is ignored, a missing one skipped."""
    base = scratch(spark, "tree")
    o = table(spark, sf_dir, "orders").withColumn("block", F.floor(F.col("o_orderkey") / FILE_ROWS))
    body = F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    lists = o.groupBy("o_orderpriority", "block").agg(body.alias("content"))
    folder = F.concat(F.lit("P "), F.substring("o_orderpriority", 1, 1))
    key = F.concat(folder, F.lit("/"), F.col("block").cast("string"), F.lit(".json"))
    B.put_objects(lists.select(key.alias("key"), "content"), base).count()
    folders = {f"P {i}": f"c_{i}" for i in (1, 2, 3, 4)} | {"absent": "c_absent"}
    docs = D.read_folder_tree(spark, base, folders)
    rows = docs.select("collection", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    status = F.try_variant_get("e", "$.o_orderstatus", "string").alias("status")
    return rows.groupBy("collection", status).agg(F.count("*").alias("n"))


@query(
    "src_missing_empty",
    """select 'stored' as name, count(*) as n from orders union all select 'missing', 0""",
)
def src_missing_empty(spark, sf_dir):
    store = scratch(spark, "store")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"), F.to_json(F.struct("o_orderstatus")).alias("doc")
    )
    D.as_envelope(docs).write.parquet(D.collection_path(store, "stored"))
    counts = [
        D.read_collection(spark, store, n).groupBy().count().select(F.lit(n).alias("name"), F.col("count").alias("n"))
        for n in ("stored", "missing")
    ]
    return counts[0].unionByName(counts[1])


@query(
    "sink_insert",
    """select o_orderstatus as status, count(*) as stored,
              sum(case when o_orderstatus = 'P' then 1 else 0 end) as rejected from orders group by 1""",
)
def sink_insert(spark, sf_dir):
    """The second insert offers every ``P`` order again and is refused."""
    store = scratch(spark, "store")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("doc"),
        "o_orderstatus",
    )
    D.insert_docs(docs.where("o_orderstatus <> 'P'"), store, "orders")
    D.insert_docs(docs.where("o_orderstatus = 'P'"), store, "orders")
    _, rejects = D.insert_docs(docs.where("o_orderstatus = 'P'"), store, "orders")
    stored = D.read_collection(spark, store, "orders")
    status = F.try_variant_get("v", "$.o_orderstatus", "string")
    refused = rejects.select("_id", "rejected")
    return (
        stored.select("_id", status.alias("status"))
        .join(refused, "_id", "left")
        .groupBy("status")
        .agg(F.count("*").alias("stored"), F.sum(F.coalesce("rejected", F.lit(0))).alias("rejected"))
    )


@query(
    "assign_ids",
    """select c_custkey, c_custkey % 2 = 0 as given, true as well_formed from customer""",
)
def assign_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    supplied = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), F.col("c_custkey")))
    with_ids = D.assign_ids(c, supplied)
    given = F.col("_id") == F.concat(F.lit("c"), F.col("c_custkey"))
    return with_ids.select(
        "c_custkey",
        given.alias("given"),
        (given | F.col("_id").rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}_\d{8}$")).alias("well_formed"),
    )


TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
COUNT_SQL = " union all ".join(f"select '{t}.parquet' as name, count(*) as n from {t}" for t in TABLE_NAMES)


@query(
    "collection_status",
    f"""select name, true as status, '✅' as display_marker, n as documents from ({COUNT_SQL})
        union all select 'missing.parquet', false, '❌', 0""",
)
def collection_status(spark, sf_dir):
    return D.collection_status(spark, sf_dir, [f"{t}.parquet" for t in TABLE_NAMES] + ["missing.parquet"])


@query(
    "sink_purge_counts",
    f"""select 'orders' as name, (select count(*) from orders) as removed,
               (select count(*) from events) as reloaded, (select count(*) from events) as documents
        union all select 'none', 0, 0, 0""",
)
def sink_purge_counts(spark, sf_dir):
    """Purge reports what it removed; the reload comes from files."""
    store, base = scratch(spark, "store"), scratch(spark, "reload")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"), F.to_json(F.struct("o_orderstatus")).alias("doc")
    )
    D.insert_docs(docs, store, "orders")
    event_files(spark, sf_dir, base)
    removed = D.purge(spark, store, ["orders", "none"], True, {"orders": [f"{base}/list-*.json"]})
    left = D.collection_status(spark, store, ["orders", "none"]).select("name", "documents")
    return removed.join(left, "name")


@query(
    "batch_refs",
    "select event_type, count(*) * 2 as n, round(sum(value) * 2, 2) as total from events group by 1",
)
def batch_refs(spark, sf_dir):
    """Two runs over the same reference, the second one appending."""
    out = scratch(spark, "batch")

    def totals(df):
        return df.groupBy("event_type").agg(
            F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")
        )

    for mode in ("truncate", "append"):
        written = D.run_batch(spark, [f"{sf_dir}/events.parquet"], out, totals, mode)
    return written.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.round(F.sum("total").cast("double"), 2).alias("total")
    )


@query(
    "data_url",
    """select page_id, 'data:' || case page_id % 4 when 0 then 'text/html' when 1 then 'image/png'
                  when 2 then 'application/x-tar' else 'application/octet-stream' end
              || ';base64,' || to_base64(encode(html)) as data_url
       from pages""",
)
def data_url(spark, sf_dir):
    name = F.concat(
        F.lit("a.b/"),
        F.element_at(F.array(*[F.lit(x) for x in ("p.HTML", "p.x.png", "p.tgz", "html")]), (F.col("page_id") % 4 + 1).cast("int")),
    )
    url = B.data_url(name, F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("data_url"))


@query(
    "copy_plan",
    """select url as source_key, 'copy/of/' || substr(url, length('https://') + 1) as target_key
       from pages where starts_with(url, 'https://') and length(url) > length('https://')""".replace("'https://'", "'http:/'"),
)
def copy_plan(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return B.plan_copy(listing, "http:/", "/copy/of//")


@query(
    "copy_tally",
    """select count(*) * 2 as total_processed, count(*) as successful_count, count(*) as failed_count,
              'success' as status, sum(strlen(html)) as copied_bytes from pages""".replace(
        "sum(strlen(html))", "cast(sum(strlen(html)) as bigint)"
    ),
)
def copy_tally(spark, sf_dir):
    """Every page is copied as an object; as many planned keys do not exist."""
    source, target = scratch(spark, "from"), scratch(spark, "to")
    pages = table(spark, sf_dir, "pages").select(
        F.format_string("in/%d.html", "page_id").alias("key"), F.col("html").alias("content")
    )
    B.put_objects(pages, source).count()
    listing = B.list_objects(spark, source).select("key")
    absent = listing.select(F.concat(F.col("key"), F.lit(".gone")).alias("key"))
    plan = B.plan_copy(listing.unionByName(absent), "in", "out")
    report = scratch(spark, "report")
    B.copy_objects(plan, source, target).write.parquet(report)
    copied = B.list_objects(spark, target).agg(F.sum("size").alias("copied_bytes"))
    return B.copy_tally(spark.read.parquet(report)).crossJoin(copied)


# -- updates ------------------------------------------------------------------
def order_updates(o):
    """Two updates per pending order, and updates of orders that do not exist."""
    p = o.where("o_orderstatus = 'P'")
    first = p.select("o_orderkey", F.lit("F").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("seq"))
    second = p.select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit(2).alias("seq"))
    unknown = first.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    same = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("seq"))
    return first.unionByName(second).unionByName(unknown).unionByName(same)


@query(
    "upd_set",
    """select o_orderkey, case when o_orderstatus = 'P' then 'F' else o_orderstatus end as o_orderstatus,
              case when o_orderstatus = 'P' then o_totalprice + 2 else o_totalprice end as o_totalprice, o_orderpriority
       from orders""",
)
def upd_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state, _ = U.merge_set(o, order_updates(o), "o_orderkey", ["o_orderstatus", "o_totalprice"], "seq")
    return state.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "upd_set_results",
    """select o_orderkey, cast(1 as integer) as matched_count, cast(case when o_orderstatus = 'P' then 1 else 0 end as integer) as modified_count,
              true as ok from orders where o_orderstatus in ('P', 'F')
       union all select -o_orderkey - 1, 0, 0, false from orders where o_orderstatus = 'P'""",
)
def upd_set_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return U.merge_set(o, order_updates(o), "o_orderkey", ["o_orderstatus", "o_totalprice"], "seq")[1]


def revised_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    doc = F.format_string('{"key":%d,"status":"%s"}', "o_orderkey", "o_orderstatus")
    target = o.select(
        F.col("o_orderkey").cast("string").alias("_id"), U.first_revision(doc).alias("_rev"), doc.alias("doc")
    )
    updates = o.select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0-stale")).otherwise(U.first_revision(doc)).alias("_rev"),
        F.format_string('{"key":%d,"status":"X"}', "o_orderkey").alias("doc"),
    )
    return target, updates


REV_SQL = """
with d as (select *, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' as doc,
                  '{"key":' || o_orderkey || ',"status":"X"}' as new_doc from orders)
"""


@query(
    "upd_rev",
    REV_SQL
    + """select cast(o_orderkey as varchar) as _id,
                case when o_orderpriority = '5-LOW' then '1-' || md5(doc) else '2-' || md5(new_doc) end as _rev,
                case when o_orderpriority = '5-LOW' then doc else new_doc end as doc from d""",
)
def upd_rev(spark, sf_dir):
    return U.replace_with_rev(*revised_orders(spark, sf_dir))[0]


@query(
    "upd_rev_conflicts",
    """select cast(o_orderkey as varchar) as _id, '0-stale' as _rev, 'stale revision' as reason
       from orders where o_orderpriority = '5-LOW'""",
)
def upd_rev_conflicts(spark, sf_dir):
    return U.replace_with_rev(*revised_orders(spark, sf_dir))[2]


@query(
    "join_writeback",
    REV_SQL
    + """select cast(o_orderkey as varchar) as _id,
                case when o_orderstatus = 'F' then '1-' || md5(doc) else '2-' || md5(new_doc) end as _rev from d""",
)
def join_writeback(spark, sf_dir):
    """Responses without a revision (finished orders) leave the document as it was."""
    batch, updates = revised_orders(spark, sf_dir)
    responses = batch.select(
        F.col("_id").alias("id"),
        F.when(
            ~F.col("doc").contains('"F"'),
            U.next_revision(F.col("_rev"), F.regexp_replace("doc", '"[OP]"', '"X"')),
        ).alias("rev"),
    )
    return U.write_back_revisions(batch, responses).select("_id", "_rev")


@query(
    "upd_tombstone",
    "select cast(o_orderkey as varchar) as _id from orders where o_orderstatus <> 'F'",
)
def upd_tombstone(spark, sf_dir):
    """Finished orders are deleted through markers; readers no longer see them."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("_id"), F.lit("1-a").alias("_rev"), "o_orderstatus")
    marks = D.tombstone(where(docs, {"o_orderstatus": "F"}))
    state = docs.join(marks.select("_id", "_deleted"), "_id", "left")
    return D.live(state).select("_id")


@query(
    "upd_last_wins",
    """select u.user_id, 'base' as origin, e.last_type, e.last_value, e.last_error from (select distinct user_id from events) u
       left join (select user_id, max_by(event_type, event_id) filter (event_type <> 'error') as last_type,
                         max_by(value, event_id) filter (event_type <> 'error') as last_value,
                         max_by(value, event_id) filter (event_type = 'error') as last_error
                  from events group by 1) e on u.user_id = e.user_id""",
)
def upd_last_wins(spark, sf_dir):
    """Updates carry different fields; for each field the last event that has it wins."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("_id")
    target = e.groupBy(user).agg(F.lit('{"origin":"base","last_type":"none"}').alias("doc"))
    error = F.col("event_type") == "error"
    doc = F.when(error, F.to_json(F.struct(F.col("value").alias("last_error")))).otherwise(
        F.to_json(F.struct(F.col("event_type").alias("last_type"), F.col("value").alias("last_value")))
    )
    merged = U.merge_documents(target, e.select(user, F.col("event_id").alias("seq"), doc.alias("doc")))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    return merged.select(
        F.col("_id").cast("bigint").alias("user_id"),
        get("origin", "string"), get("last_type", "string"), get("last_value", "double"), get("last_error", "double"),
    )


@query(
    "upd_raw_text",
    """select user_id, '{"z": 1.50, "nested": {"b": 1.0, "a": [1, 2.0]}, "type":"' || t || '", "kept": {"y":1,"x":"\\u00e9"},"added":{"d":' || k || '.0,"c":1}}' as doc
       from (select user_id, max_by(event_type, event_id) as t, max_by(cast(regexp_extract(props, '[0-9]+') as integer), event_id) as k from events group by 1)""",
)
def upd_raw_text(spark, sf_dir):
    """An update replaces the slices of its own keys; the rest of the text stays as it is written."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("_id")
    base = '{"z": 1.50, "nested": {"b": 1.0, "a": [1, 2.0]}, "type":null, "kept": {"y":1,"x":"\\u00e9"}}'
    target = e.groupBy(user).agg(F.lit(base).alias("doc"))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int").cast("string")
    doc = F.concat(F.lit('{"added":{"d":'), k, F.lit('.0,"c":1},"type":"'), "event_type", F.lit('"}'))
    merged = U.merge_documents(target, e.select(user, F.col("event_id").alias("seq"), doc.alias("doc")))
    return merged.select(F.col("_id").cast("bigint").alias("user_id"), "doc")


def append_inputs(spark, sf_dir):
    t = turns(spark, sf_dir)
    usage_type = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
    state = t.groupBy(F.col("conv_id").alias("iteration_id")).agg(
        F.lit(100).cast("bigint").alias("total_tokens"),
        F.lit(None).cast("bigint").alias("iterations_completed"),
        F.lit(None).cast(usage_type).alias("last_token_count"),
        F.lit(None).cast("timestamp").alias("last_updated"),
    )
    said = F.array(F.struct("role", F.col("text").alias("content")))
    calls = t.select(
        F.col("conv_id").alias("iteration_id"),
        F.col("turn").alias("call"),
        F.when(F.col("turn") != 2, said).alias("new_messages"),
        F.when(F.col("turn") == 2, said).alias("replace_messages"),
        F.col("usage").cast(usage_type).alias("usage"),
        F.timestamp_seconds(F.col("turn")).alias("at"),
    )
    return state, calls


@query(
    "upd_append",
    TURNS_SQL
    + """select conv_id as iteration_id, cast(100 + sum(coalesce(total_tokens, 0)) as bigint) as total_tokens,
                count(*) as iterations_completed,
                coalesce(max_by(total_tokens, turn) filter (role <> 'system'), -1) as last_total,
                max(turn) as last_second
         from turns group by 1""",
)
def upd_append(spark, sf_dir):
    """Every call counts as an iteration, with or without usage."""
    state, calls = append_inputs(spark, sf_dir)
    done = U.append_metadata(state, calls)
    return done.select(
        "iteration_id", "total_tokens", "iterations_completed",
        F.coalesce("last_token_count.total_tokens", F.lit(-1)).alias("last_total"),
        F.unix_timestamp("last_updated").alias("last_second"),
    )


@query(
    "upd_append_messages",
    """with kept as (
         select conv_id, turn, role, text,
                max(turn) filter (turn = 2) over (partition by conv_id) as since from conversations)
       select conv_id as iteration_id, cast(0 as bigint) as segment, count(*) as n,
              string_agg(role || ': ' || text, chr(10) order by turn) as transcript
       from kept where since is null or turn >= since group by 1""",
)
def upd_append_messages(spark, sf_dir):
    """Turn 2 overwrites the message list; later turns are appended again."""
    _, calls = append_inputs(spark, sf_dir)
    none = spark.createDataFrame([], "iteration_id bigint, call bigint, position int, role string, content string")
    rows = U.append_messages(none, calls)
    docs = collect_messages(rows, "iteration_id", ["call", "position"], ["role", "content"])
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return docs.select(
        "iteration_id", "segment", F.size("messages").cast("bigint").alias("n"), F.array_join(line, "\n").alias("transcript")
    )


@query(
    "upd_laid_out",
    """select o_orderkey, case when o_orderkey % 97 = 0 then '{"status":"X","total":1.50}' else '{"status":"' || o_orderstatus || '"}' end as doc from orders
       where o_orderkey % 89 <> 0 union all select -o_orderkey, '{"new":true}' from orders where o_orderkey % 89 = 0""",
)
def upd_laid_out(spark, sf_dir):
    """Updates and inserts of a collection laid out by id; only the partitions they fall into are replaced."""
    path = scratch(spark, "laid")
    o = table(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey").cast("string"))
    body = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}'))
    L.lay_out(o.where("o_orderkey % 89 <> 0").select("_id", F.lit(None).cast("string").alias("_rev"), body.alias("doc")), path, 16, 8)
    changes = o.where("o_orderkey % 97 = 0").select("_id", F.lit(1).alias("seq"), F.lit('{"status":"X","total":1.50}').alias("doc"))
    L.update_laid_out(spark, path, changes, lambda stored: U.merge_documents(stored, changes), 16, 8)
    new = o.where("o_orderkey % 89 = 0").select(F.concat(F.lit("-"), "_id").alias("_id"), F.lit(None).cast("string").alias("_rev"), F.lit('{"new":true}').alias("doc"))
    L.update_laid_out(spark, path, new, lambda stored: L.insert_new(stored, new), 16, 8)
    return L.laid_out(spark, path, 16, 8).select(F.col("_id").cast("bigint").alias("o_orderkey"), "doc")
