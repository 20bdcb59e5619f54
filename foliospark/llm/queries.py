"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import configure
from .checks import ARCHIVE_SQL, CONTAMINATION_SQL, REPAIR_SQL, RULES_SQL, SPELLING_SQL
from .decontaminate import contamination
from .html import main_text
from .language import identified
from .mixing import mixture
from .neardup import near_duplicates
from .packing import packed
from .pii import personal_data
from .quality import grade, ratings, train_grader
from .repair import damaged, repair_report
from .rules import quality_report
from .spelling import lexicon, spelling_variants
from .tokens import read_tokens, write_tokens
from .warc import archived_pages

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql.strip()
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_minhash_dedup")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark, sf_dir):
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary()))


@query("op4_decontaminate", CONTAMINATION_SQL)
def op4(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_mix_sources")
def op8(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


@query("op9_personal_data")
def op9(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


@query("op10_quality_rules", RULES_SQL)
def op10(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents"))


#: least grade that is kept: 0 is of low quality, 1 sound but toxic, 2 sound
SOUND = 2


def quality_grader(spark, sf_dir):
    """The grader fitted to the labelled documents of a data folder."""
    return train_grader(ratings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), grades=3)


@query("op7_quality_grade")
def op7(spark, sf_dir):
    return grade(table(spark, sf_dir, "documents"), quality_grader(spark, sf_dir), SOUND)


@query("op5_main_text")
def op5(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query("op6_warc", ARCHIVE_SQL)
def op6(spark, sf_dir):
    return archived_pages(table(spark, sf_dir, "pages")).drop("intact")


@query("op11_spelling_variants", SPELLING_SQL)
def op11(spark, sf_dir):
    return spelling_variants(lexicon(table(spark, sf_dir, "documents"), slip=199))


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, sf_dir):
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


@query("op13_best_fit_packing")
def op13(spark, sf_dir):
    pieces = packed(table(spark, sf_dir, "documents"), vocabulary())
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "piece", "start", "length", digest, "sequence_id", "offset")
