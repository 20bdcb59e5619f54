"""Quality rules as a short-circuit cascade, on DataFrame expressions only.

A rule is a named test on one text.  On a sample the cascade measures what each rule costs
(seconds its evaluation adds to a job over the sample) and how many texts it rejects, then
orders the rules by rejections per second.  The rules become one chain of ``CASE WHEN``
branches: a text that a rule rejects is not shown to the rules behind it.  The order changes
the work, never the verdict, since a text is kept exactly when every rule accepts it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, own_columns

#: a word: anything but blank, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: rows of the sample on which rules are measured, about, how often each is tested in a run, and runs
SAMPLE_ROWS = 2000
REPEATS = 4
TIMES = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """One hash for each run of ``width`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    runs = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in text order.

    Sorting (hash, place) brings equal windows together; their places, sorted again, are
    walked once, each adding the words not covered by the one before.
    """
    sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(pairs):
        same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def walked(at):
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
        return F.aggregate(at, zero, step)["n"]

    # one-element arrays bind a value once for all the places that use it
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    repeated = let(sorted_pairs, lambda pairs: let(places(pairs), walked))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text and the words' array and is true where the text fails."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _ratio_over(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda text, words: F.size(words) < 10),
        Rule(
            "repeated_words",
            lambda text, words: _ratio_over(covered_words(window_hashes(words)), F.size(words), 20),
        ),
    ]


def method_rules() -> list[Rule]:
    """Rules with bounds that ordinary prose in any language keeps far away from."""
    return [
        Rule("symbols", lambda text, words: _ratio_over(F.regexp_count(text, F.lit(SYMBOLS)), F.size(words), 20)),
        Rule("duplicate_lines", lambda text, words: _ratio_over(duplicate_lines(text), F.size(F.split(text, "\n", -1)), 40)),
        Rule("long_words", lambda text, words: F.length(F.array_join(words, "")) > 25 * F.size(words)),
        Rule("shouting", lambda text, words: _ratio_over(F.regexp_count(text, F.lit("!!")), F.size(words), 30)),
    ]


def _seconds(rows: DataFrame, verdict: Column) -> tuple[float, int]:
    """The shortest time to evaluate ``verdict`` on all rows, and how often it holds."""
    times, found = [], 0
    for _ in range(TIMES):
        began = time.perf_counter()
        found = rows.agg(F.count_if(verdict)).first()[0]
        times.append(time.perf_counter() - began)
    return min(times), found


def measured_order(docs: DataFrame, rules: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by falling rejections per second on a random sample of about ``rows`` rows.

    A rule's cost is what its evaluation adds to a job that reads the sample anyway: the
    shortest of a few runs over the sample repeated, the first of which also compiles it, less
    the shortest run of a test that costs nothing.  The sample stays where it was read; only
    counts move.
    """
    drawn = docs.filter(F.rand(17) < rows / max(1, docs.count()))
    sample = drawn.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = sample.select("text", words_of(F.col("text")).alias("words")).persist()
    try:
        sample.count()
        again = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))
        idle, _ = _seconds(again, F.col("again") > REPEATS)
        scored = []
        for rule in rules:
            # the number of the repetition is in the test, so that none is skipped as known
            seconds, rejected = _seconds(again, rule.rejects(F.col("text"), F.col("words")) & (F.col("again") > 0))
            cost = max(seconds - idle, idle / 100)
            scored.append((-(rejected + 0.5) / cost, rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(scored, key=lambda x: x[0])]


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """True where every rule accepts; rules behind the first that rejects are not evaluated."""
    chain = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(text, words), F.lit(False))
        chain = F.when(hit, F.lit(False)) if chain is None else chain.when(hit, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept``: the verdict of all rules, in measured order.

    A null text counts as an empty one.
    """
    order = measured_order(docs, base_rules() + method_rules() if rules is None else rules, text_col)
    text, words = fresh(docs.columns, "_text", "_words")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(words, words_of(F.col(text)))
    kept = cascade(order, F.col(text), F.col(words)).alias("kept")
    return rows.select(*[c for c, n in zip(own_columns(docs), docs.columns, strict=True) if n.lower() != "kept"], kept)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the base figures and the verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    The base figures are wanted for every text, so only the method's own rules are left to
    the cascade, and only for texts that pass the base.  Null and empty texts have no words
    and fail; repeated rows are each reported; other columns are not looked at.
    """
    order = measured_order(docs, method_rules(), text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = rows.select("*", window_hashes(F.col("words")).alias("hashes"))
    rows = rows.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        covered_words(F.col("hashes")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, F.col("text"), F.col("words")))
    return rows.withColumn("kept", verdict).drop("text", "words")
