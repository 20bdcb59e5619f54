"""Multi-turn generation with a user's function, and per-record scoring.

The function runs in Python workers over Arrow batches; each document is
independent, so Spark spreads them and no state crosses rows.  Turns are written round by
round, so that none that was paid for is asked again.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.files import exists
from .messages import ITERATION_LENGTH, NEXT_MESSAGE, STARTER_MESSAGES

NEXT_USER_MESSAGE = {"role": "user", "content": [{"type": "text", "text": NEXT_MESSAGE}]}


def init_iterations(df: DataFrame, created_at: Column | None = None, **overrides) -> DataFrame:
    """New iteration documents with starter messages and zeroed metadata.

    ``df`` brings ``iteration_id, user_id, org_id, parameter_set_name,
    system_template_name, user_context`` and optionally ``language``.
    """
    length = overrides.get("iteration_length", ITERATION_LENGTH)
    starter = overrides.get("starter_messages") or STARTER_MESSAGES
    following = overrides.get("next_question_user_message") or NEXT_USER_MESSAGE
    created = F.current_timestamp() if created_at is None else created_at
    language = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    return df.select(
        *[c for c in ("_id", "iteration_id", "user_id", "org_id", "parameter_set_name", "system_template_name") if c in df.columns],
        F.lit(json.dumps(following)).alias("next_question_user_message"),
        F.lit(length).alias("iteration_length"),
        "user_context",
        language.alias("language"),
        F.struct(
            F.lit(json.dumps(starter)).alias("messages"),
            F.array().cast("array<string>").alias("results"),
            F.struct(
                F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
                zero.alias("total_tokens"),
                zero.alias("iterations_completed"),
            ).alias("metadata"),
        ).alias("generation_content"),
    )


GENERATED = "round int, response string, role string, content string, error string"
#: the conversation after a turn, which the next round starts from; null where it has ended
SAID = "said string"


def generate(
    df: DataFrame,
    fn,
    rounds: int,
    keys: list[str],
    messages: str = "messages",
    continuation: str = NEXT_MESSAGE,
    on_iteration=None,
    store: str | None = None,
) -> DataFrame:
    """One row per response of ``fn(messages) -> dict | None``, for up to ``rounds`` rounds.

    A null result stops; a result without choices is kept and stops.  Otherwise the
    assistant message joins the conversation and, except after the last round, a
    continuation message follows.  ``on_iteration(round, result, messages)`` is called
    per turn; its failure is recorded in ``error`` and does not stop the loop.

    Every round is a job of its own whose turns are written before anything follows from them, so
    a lost executor costs at most the turns of the round it was in, and the hook sees stored turns
    only.  With ``store``, a folder all executors reach, a repeated call goes on behind the last
    round written there; without it the rounds go to a fresh folder.
    """
    spark = df.sparkSession
    store = store or scratch(spark, "rounds")
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    follow_up = {"role": "user", "content": continuation}
    start = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    now = df.select(*keys, F.to_json(start, {"ignoreNullFields": "false"}).alias("said")).where(F.size(messages) > 0)
    done = []
    for number in range(rounds):
        turns = _stage(now, f"{store}/turns-{number}", types, _turn(fn, number, follow_up, keys), f"{types}, {GENERATED}, {SAID}")
        if on_iteration is not None:
            heard = _hook(on_iteration, number, keys)
            turns = _stage(turns, f"{store}/heard-{number}", types, heard, f"{types}, {GENERATED}, {SAID}")
        done.append(turns.drop("said"))
        now = turns.where("said is not null").select(*keys, "said")
        if number + 1 < rounds and now.isEmpty():
            break
    empty = spark.createDataFrame([], f"{types}, {GENERATED}")
    return reduce(DataFrame.unionByName, done, empty) if done else empty


def _stage(rows: DataFrame, path: str, types: str, work, schema: str) -> DataFrame:
    """``work`` over ``rows``, written to ``path`` unless an earlier call has written it whole."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.mapInPandas(work, schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _turn(fn, number: int, follow_up: dict, keys: list[str]):
    """One turn of every conversation of a batch, as GENERATED and SAID columns."""

    def run(batches):
        for batch in batches:
            out = []
            for *key, text in zip(*[batch[c] for c in (*keys, "said")], strict=True):
                said = json.loads(text)
                if number:
                    said.append(follow_up)
                response = fn(said)
                if response is None:
                    continue
                answered = (response.get("choices") or [None])[0]
                message = (answered or {}).get("message", {})
                after = None if answered is None else json.dumps([*said, message], ensure_ascii=False)
                told = json.dumps(response, ensure_ascii=False)
                out.append((*key, number + 1, told, message.get("role"), message.get("content"), None, after))
            yield pd.DataFrame(out, columns=[*keys, "round", "response", "role", "content", "error", "said"])

    return run


def _hook(hook, number: int, keys: list[str]):
    """The hook on every stored turn that has an answer."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch["response"], batch["said"], strict=True)
            batch["error"] = [None if s is None else _failure_of(hook, number, json.loads(r), json.loads(s)) for r, s in pairs]
            yield batch

    return run


def _failure_of(hook, *arguments) -> str | None:
    """What went wrong in a user's hook; it must not end the conversation."""
    try:
        hook(*arguments)
    except Exception as problem:
        return str(problem)
    return None


def response_usage(response: Column) -> Column:
    usage = F.from_json(F.get_json_object(response, "$.usage"), "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    return usage


def score_records(df: DataFrame, score, payload: str, keep: list[str]) -> DataFrame:
    """A user's ``score(payload dict) -> dict`` per record; shipped once per worker."""
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch in batches:
            responses = [json.dumps(score(json.loads(p)), ensure_ascii=False) for p in batch[payload]]
            yield batch[keep].assign(response=responses)

    return df.select(*keep, payload).mapInPandas(run, f"{key_types}, response string")
