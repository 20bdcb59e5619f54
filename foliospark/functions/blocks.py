"""Configuration blocks inside generated text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITER = "-{3,}"


def extract_blocks(
    text: Column, delimiter: str = DELIMITER, extract_delimited: bool = True, fallback_to_full: bool = True
) -> Column:
    """Blocks between delimiter lines, trimmed, empty ones dropped.

    A delimiter line holds nothing but the token and blanks.  Without any such line
    the whole text is one block, or none when ``fallback_to_full`` is off.
    """
    whole = F.filter(F.array(stripped(text)), lambda b: b != "")
    if not extract_delimited:
        return whole
    fence = rf"(?m)^[ \t]*(?:{delimiter})[ \t]*$"
    parts = F.filter(F.transform(F.split(text, fence), stripped), lambda b: b != "")
    otherwise = whole if fallback_to_full else F.array().cast("array<string>")
    fenced = text.rlike(fence)
    return F.when(fenced & (F.size(parts) > 0), parts).when(text.isNotNull(), otherwise)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# A flat block needs no YAML reader: lower-case keys, and values that are a plain
# word, an integer or a decimal that YAML reads the same way.
FLAT_LINE = r"[A-Za-z_][A-Za-z0-9_]*: (?:-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]+)?|[A-Za-z][A-Za-z0-9_#-]*)"
FLAT_BLOCK = rf"^{FLAT_LINE}(?:\n{FLAT_LINE})*$"
# Words YAML reads as booleans or null.
YAML_WORDS = r"(?i)^(?:y|n|yes|no|true|false|on|off|null)$"


def flat_json(block: Column) -> Column:
    """JSON text of a flat ``key: scalar`` block; NULL for any other block."""
    lines = F.split(block, "\n")
    entries = F.transform(
        lines,
        lambda l: F.struct(F.substring_index(l, ": ", 1).alias("key"), F.regexp_replace(l, "^[^:]*: ", "").alias("value")),
    )
    special = F.exists(entries, lambda e: e["value"].rlike(YAML_WORDS) | e["key"].rlike(YAML_WORDS))
    unique = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == F.size(entries)
    fields = F.transform(
        entries,
        lambda e: F.concat(
            F.lit('"'), e["key"], F.lit('":'),
            F.when(e["value"].rlike("^-?[0-9]"), e["value"]).otherwise(F.concat(F.lit('"'), e["value"], F.lit('"'))),
        ),
    )
    plain = block.rlike(FLAT_BLOCK) & ~special & unique
    return F.when(plain, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


# Fixed value: an indented key whose name may need quotes, and how it is repaired.
LOOSE_KEY = re.compile(r"^\s{2,}(\w[\w\s]*?):\s*(.+)$", re.M)
REPAIRED_KEY = r"  '\1': \2"


def _to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def _yaml_documents(text: str):
    """All documents of a YAML text; None where it is not YAML."""
    import yaml

    # the C reader where the library was built with it: same rules, much faster
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        return list(yaml.load_all(text, loader))
    except yaml.YAMLError:
        return None


def load_mappings(text: str | None, stream: bool) -> list[str]:
    """JSON texts of the YAML mappings in a text; anything else is left out.

    A block is one document.  Where it cannot be read so, its loose keys are quoted first.
    """
    readings = [text or ""]
    if not stream:
        readings.append(LOOSE_KEY.sub(REPAIRED_KEY, readings[0].strip()))
    for documents in map(_yaml_documents, readings):
        if documents is not None and (stream or len(documents) < 2):
            return [_to_json(d) for d in documents if isinstance(d, dict)]
    return []


def _loader(stream: bool):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: load_mappings(t, stream))

    return run


def parse_configs(
    df: DataFrame,
    text: str,
    keep: list[str],
    extract_delimited: bool = True,
    fallback_to_full: bool = True,
    delimiter: str = DELIMITER,
) -> DataFrame:
    """One row per parsed mapping: ``block, position, config`` (JSON text).

    Flat blocks are read natively; only the rest goes to Python, as Arrow batches.
    With ``extract_delimited=False`` the whole text is one YAML stream.
    """
    if extract_delimited:
        blocks = extract_blocks(F.col(text), delimiter, True, fallback_to_full)
        rows = df.select(*keep, F.posexplode(blocks).alias("block", "_text"))
    else:
        rows = df.select(*keep, F.lit(0).alias("block"), F.col(text).alias("_text")).where(F.col("_text").rlike(r"\S"))
    # a mapping needs one of these characters; other text is dropped before parsing
    rows = rows.where(F.col("_text").rlike("[:{?]")).withColumn("_flat", flat_json(F.col("_text")))
    # one pass: Python is sent only the texts that need it, NULL for the rest
    needs_python = F.when(F.col("_flat").isNull(), F.col("_text"))
    loaded = rows.withColumn("_loaded", _loader(not extract_delimited)(needs_python))
    found = F.when(F.col("_flat").isNotNull(), F.array("_flat")).otherwise(F.col("_loaded"))
    return loaded.select(*keep, "block", F.posexplode(found).alias("position", "config"))


def config_array(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Configs of one text as an ordered array, with their number.

    A text holds a bounded number of blocks, so the array is bounded by its size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block", "position", "config")))
    lists = rows.groupBy(*keys).agg(ordered.alias("_c"))
    return lists.select(*keys, F.transform("_c", lambda c: c["config"]).alias("configs"), F.size("_c").alias("n_configs"))
