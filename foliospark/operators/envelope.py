"""Scoring envelopes: positional ``fields``/``values`` requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import to_variant

ENVELOPE = "input_data array<struct<fields:array<string>,values:array<array<variant>>>>"
PREDICTIONS = "predictions array<struct<fields:array<string>,values:array<array<variant>>>>"
MAX_ROWS = 1000  # value rows per envelope


def _values(df: DataFrame, columns: list[str]) -> Column:
    """Column values as a positional array of VARIANT; missing ones are JSON null."""
    null = F.parse_json(F.lit("null"))
    return F.array(*[F.coalesce(to_variant(F.col(c), df.schema[c].dataType), null) for c in columns])


def to_envelope(df: DataFrame, columns: list[str], key: str, position: Column, size: int = MAX_ROWS) -> DataFrame:
    """Multi-record requests per key, at most ``size`` rows each, in ``position`` order.

    ``position`` numbers the rows of a key (any integers); rows are split by
    ``position div size``, so a key of any size becomes several bounded requests.
    """
    rows = df.select(F.col(key), position.alias("_p"), _values(df, columns).alias("_row"))
    # VARIANT cannot be sorted: order by position, carry the row as JSON text
    packed = F.array_sort(F.collect_list(F.struct("_p", F.to_json("_row").alias("row"))))
    lists = rows.groupBy(key, F.floor(F.col("_p") / size).alias("part")).agg(packed.alias("_rows"))
    body = F.array_join(F.transform("_rows", lambda r: r["row"]), ",")
    fields = F.to_json(F.array(*[F.lit(c) for c in columns]))
    payload = F.concat(F.lit('{"input_data":[{"fields":'), fields, F.lit(',"values":['), body, F.lit("]}]}"))
    return lists.select(key, "part", payload.alias("payload"))


def record_envelope(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Single-record requests; fields without a value are left out."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("f"), F.to_json(to_variant(F.col(c), df.schema[c].dataType)).alias("v")))
                for c in columns
            ]
        )
    )
    fields = F.to_json(F.transform(entries, lambda e: e["f"]))
    values = F.concat(F.lit("[["), F.array_join(F.transform(entries, lambda e: e["v"]), ","), F.lit("]]"))
    payload = F.concat(F.lit('{"input_data":[{"fields":'), fields, F.lit(',"values":'), values, F.lit("}]}"))
    return df.select(*keep, payload.alias("payload"))


def _zipped(fields: Column, values: Column) -> Column:
    """Fields with their values; without fields the names are ``param_0`` and so on."""
    numbered = F.transform(values, lambda _, i: F.concat(F.lit("param_"), i.cast("string")))
    names = F.when(F.size(fields) > 0, fields).otherwise(numbered)
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n))


def from_envelope(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One ``params`` map per value row of every request."""
    parsed = F.from_json(F.col(payload), ENVELOPE)["input_data"]
    requests = df.select(*keep, F.explode(parsed).alias("_in"))
    rows = requests.select(*keep, F.posexplode("_in.values").alias("row", "_values"), F.col("_in.fields").alias("_fields"))
    return rows.select(*keep, "row", _zipped(F.coalesce("_fields", F.array().cast("array<string>")), F.col("_values")).alias("params"))


def unpack_prediction(response: Column, result_key: str) -> Column:
    """``struct<result, debug_logs, error>`` of a response; malformed ones become errors."""
    first = F.get(F.from_json(response, PREDICTIONS)["predictions"], F.lit(0))
    values = F.get(first["values"], F.lit(0))
    m = _zipped(first["fields"], values)
    text = lambda key: F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "string")
    logs = F.to_json(F.try_element_at(m, F.lit("debug_logs")))
    well_formed = first["fields"].isNotNull() & values.isNotNull()
    result = F.coalesce(F.to_json(F.try_element_at(m, F.lit(result_key))), F.lit("{}"))
    none = F.lit(None).cast("string")

    def out(a, b, c):
        return F.struct(a.alias("result"), b.alias("debug_logs"), c.alias("error"))

    return (
        F.when(~F.coalesce(well_formed, F.lit(False)), out(none, none, F.lit("unexpected response structure")))
        .when(F.coalesce(text("status") == "error", F.lit(False)), out(none, logs, text("error")))
        .otherwise(out(result, logs, none))
    )
