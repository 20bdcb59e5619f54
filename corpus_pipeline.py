"""The training-data pipeline over ``documents``: grade, near-dedup, decontaminate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.  ORACLE_SQL is None: SQL expresses neither the trained grader nor the
tokenizer; the tests hold each stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.llm.decontaminate import contamination
from foliospark.llm.mixing import mixed_documents
from foliospark.llm.neardup import near_duplicates
from foliospark.llm.quality import keep_graded
from foliospark.llm.queries import SOUND, quality_grader, table, vocabulary
from foliospark.llm.tables import fresh, own_columns
from foliospark.llm.tokens import read_tokens, write_tokens
from foliospark.session import configure, scratch


def quality(spark, docs, sf_dir):
    """Documents that the grader accepts; the grader learns from the labelled documents."""
    return keep_graded(docs, quality_grader(spark, sf_dir), SOUND)


def near_dedup(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies, of similarity 0.8 or more.

    Rows that repeat an id all go or stay together; rows without an id stay.
    """
    (key,) = fresh(docs.columns, "_gone")
    gone = near_duplicates(docs, percent=80).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti").select(*own_columns(docs))


def decontaminate(spark, docs, sf_dir):
    """Documents in which no window of a benchmark item occurs.

    Of rows that repeat an id all go if one is hit; rows without an id are told by their text.
    """
    (hit,) = fresh(docs.columns, "_hit")
    key = F.coalesce(F.col("doc_id"), -F.abs(F.xxhash64("text")) - 1)
    found = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(gone, key == F.col(hit), "left_anti").select(*own_columns(docs))


def mix(spark, docs, sf_dir):
    """Every document as often as the mixture takes it, 0 to 3 times."""
    return mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    """Token files of all that is left; per row what the files hold."""
    return read_tokens(write_tokens(docs, vocabulary()))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to ``documents``, each written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
