"""Spelling variants of the words of a corpus, found by sorted rotations (a permuterm).

1. ``lexicon`` counts the words of whole texts; tasks count what they read, then Spark adds up.
2. Every word, closed by a mark, is written in all its rotations.  Fixing what stands around one
   place of the word makes that place the end of a rotation: two words that differ only there
   have rotations equal but for the last letter, and a word without a letter there has the
   common part itself as a rotation.  So each row carries the rotation without the edited
   letter as ``key``; rows are dealt by ranges of sorted keys and scanned key by key.  A key
   holds at most one word per letter of the alphabet and one word that lacks it.
3. A scanned key gives every word in it the number of its neighbours there and the best of
   them, not the pairs.  A word pair meets in one key only: a replaced letter has one place,
   and of a run of equal letters only the first counts as the inserted one.

Forms are followed to the root by doubling: counts grow by ``ratio`` a step, so the chains are
short and without rings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

# Letters of a word, in UTF-8 after A-Z is folded (U+00C0 to U+00FF lead with C3).
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
MARK = "$"
HELD_WORDS = 400_000


def _slipped(word: bytes, h: int) -> bytes:
    """The word without one letter, the place told by ``h``."""
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(batches, slip: int | None, shortest: int):
    held: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )
        held.clear()
        return out

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc in enumerate(ids):
            text = texts[i].as_py() or b""
            found = Counter(map(re.Match.group, RUN.finditer(text.lower())))
            if slip:
                begun = zlib.crc32(f"{doc}:".encode())
                hit = [(w, h) for w in found if not (h := zlib.crc32(w, begun)) % slip]
                changed = [(_slipped(w, h), found.pop(w)) for w, h in hit]
                for word, n in changed:
                    found[word] += n
            for word, n in found.items():
                # bytes bound the letters from above, so only words with marks are decoded
                if len(word) >= shortest and (word.isascii() or len(word.decode()) >= shortest):
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield rows()
    if held:
        yield rows()


def lexicon(
    docs: DataFrame, id_col="doc_id", text_col="text", slip: int | None = None, shortest: int = 6, least: int = 5
) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters occurring ``least`` times or more in whole texts.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF with A-Z folded.  With ``slip``, every run
    for which that number divides the crc32 of ``<id>:<run>`` loses one letter first (a null id
    counts as empty text).  Null and empty texts have no words; an empty table gives no rows;
    repeated rows count as often as they stand; other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    part = rows.mapInArrow(lambda it: _counted(it, slip, shortest), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _rotations(words: DataFrame) -> DataFrame:
    """(key, letter, n): a word's rotations, whole (letter empty) and without their last letter."""
    places = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    before, after = F.expr("left(word, at)"), F.expr("substr(word, at + 1)")
    whole = F.struct(F.concat(after, F.lit(MARK), before).alias("key"), F.lit("").alias("letter"))
    open_ = F.struct(
        F.concat(F.expr("substr(word, at + 2)"), F.lit(MARK), before).alias("key"), F.expr("substr(word, at + 1, 1)").alias("letter")
    )
    both = F.when(F.col("at") < F.length("word"), F.array(whole, open_)).otherwise(F.array(whole))
    return places.select(F.explode(both).alias("r"), "n").select("r.key", "r.letter", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<m, word>) of the words that have a neighbour; m is minus its count.

    ``words`` (word, n) are distinct.  Neighbours differ by one letter replaced, inserted or
    deleted; the best is the most frequent, the smallest in code-point order among equals.
    """
    rows = _rotations(words).repartitionByRange("key").sortWithinPartitions("key", "letter")
    around = F.split("key", re.escape(MARK))
    member = F.struct(
        (-F.col("n")).alias("m"),
        F.concat(around[1], "letter", around[0]).alias("word"),
        (F.col("letter") == "").alias("lacks"),
        (F.col("letter") != F.expr("right(key, 1)")).alias("first"),
    )
    scan = rows.withColumn("member", member).groupBy("key").agg(F.sort_array(F.collect_list("member")).alias("all"))

    def met(own):
        def linked(other):
            return (~other["lacks"] & ~own["lacks"]) | (other["lacks"] & own["first"]) | (own["lacks"] & other["first"])

        near = F.filter("all", lambda other: (other["word"] != own["word"]) & linked(other))
        best = F.transform(near, lambda o: F.struct(o["m"].alias("m"), o["word"].alias("word")))
        return F.struct(own["word"].alias("word"), best.alias("near"))

    each = scan.filter(F.size("all") > 1).select(F.explode(F.transform("all", met)).alias("e")).select("e.word", "e.near")
    each = each.filter(F.size("near") > 0).select("word", F.size("near").alias("k"), F.col("near")[0].alias("best"))
    return each.groupBy("word").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each (word, form) followed to the last form, in as many rounds as the log of the longest chain."""
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``words`` (word, n; distinct, not null).

    form: the best neighbour, if it is at least ``ratio`` times (2 or more) as frequent, else
    null.  root: the last of the forms, or the word itself.
    """
    words = stored(words.select("word", "n"), "lexicon")
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    found = words.join(neighbours(words), "word", "left").withColumn("form", form)
    found = found.select("word", F.col("form.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("form.m")).alias("form_n"))
    found = stored(found, "forms")
    last = roots(found.filter("form is not null"))
    out = found.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
