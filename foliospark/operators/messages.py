"""Prompt messages: rendering them, and taking them apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import elements_of
from ..functions.paths import as_json, text_kind
from ..functions.template import compile_template, render_value, scope_of

# The starter messages every new iteration document gets.
SYSTEM_TEMPLATE = (
    "{{ system_prompt }}{% if context %}\n\nContext:\n{{ context }}{% endif %}"
    "{% if language %}\n\nOutput Language: {{ language }}{% endif %}"
)
USER_TEMPLATE = (
    "{% if user_context %}{% for key, value in user_context.items() %}{% if value %}\n"
    "{{ key | replace('_', ' ') | title }}: {{ value }}{% endif %}{% endfor %}{% endif %}"
)
NEXT_MESSAGE = "Generate Next Output."
ITERATION_LENGTH = 5

STARTER_MESSAGES = [
    {"role": "system", "content": SYSTEM_TEMPLATE},
    {"role": "user", "content": [{"type": "text", "text": USER_TEMPLATE}]},
]


def build_messages(
    df: DataFrame, variables: dict[str, str] | None = None, contexts: list[str] | None = None, filters=None
) -> DataFrame:
    """Add ``messages``: system prompt with context and language, then user context lines.

    ``variables`` are template-valued names such as ``system_prompt``; everything
    else is read from the frame's columns.
    """
    scope = scope_of(df, contexts)

    def text(source: str) -> Column:
        return compile_template(source, scope, variables, filters)

    messages = F.array(
        F.struct(F.lit("system").alias("role"), text(SYSTEM_TEMPLATE).alias("content")),
        F.struct(F.lit("user").alias("role"), text(USER_TEMPLATE).alias("content")),
    )
    return df.withColumn("messages", messages)


def rendered_messages(df: DataFrame, starter: list[dict], variables=None, contexts=None, filters=None) -> Column:
    """Any starter message list rendered in place; ``content`` may be text or parts."""
    scope = scope_of(df, contexts)
    rows = []
    for message in starter:
        content = render_value(message["content"], scope, variables, filters)
        is_text = isinstance(message["content"], str)
        rows.append(
            F.struct(
                F.lit(message["role"]).alias("role"),
                (content.cast("variant") if is_text else F.to_variant_object(content)).alias("content"),
            )
        )
    return F.array(*rows)


def explode_parts(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Rows ``part_type, text, image_url`` for content that is a text or a list of parts."""
    v = F.col(content)
    is_list = text_kind(as_json(v)) == "array"
    whole = F.array(
        F.to_variant_object(F.struct(F.lit("text").alias("type"), F.try_variant_get(v, "$", "string").alias("text")))
    )
    parts = df.select(*keep, F.posexplode(F.when(is_list, elements_of(v)).otherwise(whole)).alias("position", "part"))
    get = lambda path: F.try_variant_get("part", path, "string")
    return parts.select(
        *keep, "position", get("$.type").alias("part_type"), get("$.text").alias("text"), get("$.image_url.url").alias("image_url")
    )


def example_pair(instruction: Column, image_url: Column, answer: Column) -> Column:
    """A few-shot example: a user message with text and image, and the expected answer."""
    parts = F.array(
        F.struct(F.lit("text").alias("type"), instruction.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
        F.struct(
            F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
            F.struct(image_url.alias("url")).alias("image_url"),
        ),
    )
    user = F.struct(F.lit("user").alias("role"), F.parse_json(F.to_json(parts)).alias("content"))
    return F.array(user, F.struct(F.lit("assistant").alias("role"), answer.cast("variant").alias("content")))


def rebuild_transcript(initial: Column, messages: Column) -> Column:
    """The initial messages followed by the assistant's; continuations are left out."""
    return F.concat(initial, F.filter(messages, lambda m: m["role"] == "assistant"))


MESSAGE_TYPE = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
