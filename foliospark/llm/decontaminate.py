"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every word of the corpus: each row is a segment, a
bounded run of whole documents with its own sorted term table and, per term, the ascending
word positions.  The index knows nothing of any benchmark and can answer later ones.

``phrase_matches`` looks phrases up in blocks of bounded size.  The lists of a phrase are
shifted by the word's offset in it and intersected from the rarest term of the corpus on, so
a phrase costs as much as its rarest word.  With ``slop`` > 0 a word may stand that many
positions away from its place (proximity matches).

Segments are independent rows: a frequent word or passage is spread over all of them, and no
list is ever gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import ALNUM, text_blocks, word_hashes

WINDOW = 10
SEGMENT_BYTES = 1 << 19
#: benchmark words looked up in one pass over the index
BLOCK_WORDS = 1 << 18

INDEX = (
    "segment long, doc_ids array<long>, n_words array<long>, terms binary, ends binary, postings binary"
)


def _segments(batches):
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row, data, offsets in text_blocks(batch.column(1), SEGMENT_BYTES):
            words, first, _, _ = word_hashes(data, offsets, ALNUM)
            order = np.argsort(words, kind="stable")
            by_term = words[order]
            opens = np.flatnonzero(np.r_[True, by_term[1:] != by_term[:-1]]) if len(words) else np.zeros(0, np.int64)
            ends = np.r_[opens[1:], len(words)] if len(words) else opens
            # positions as steps inside each list, so that they pack well
            steps = np.diff(order, prepend=0)
            steps[opens] = order[opens]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "segment": part << 32 | count,
                        "doc_ids": ids[row : row + len(offsets) - 1],
                        "n_words": np.diff(first).tolist(),
                        "terms": by_term[opens].astype("<u8").tobytes(),
                        "ends": ends.astype("<u4").tobytes(),
                        "postings": steps.astype("<u4").tobytes(),
                    }
                ],
                schema=_INDEX_TYPE,
            )
            count += 1


_INDEX_TYPE = pa.schema(
    [
        ("segment", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("ends", pa.binary()),
        ("postings", pa.binary()),
    ]
)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all words of ``docs``; written, one row a segment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_segments, INDEX), "index")


class Segment:
    """One row of the index."""

    def __init__(self, row: dict):
        self.firsts = np.cumsum([0, *row["n_words"]])
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.steps = np.frombuffer(row["postings"], "<u4")
        self.lists: dict[int, np.ndarray] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the term table, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def positions(self, k: int) -> np.ndarray:
        if k not in self.lists:
            begin = self.ends[k - 1] if k else 0
            self.lists[k] = np.cumsum(self.steps[begin : self.ends[k]], dtype=np.int64)
        return self.lists[k]


def _near(starts: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
    """Those of ``starts`` with a value of ``places`` at most ``slop`` away; both ascending."""
    at = np.searchsorted(places, starts - slop)
    hit = at < len(places)
    hit[hit] = places[at[hit]] <= starts[hit] + slop
    return starts[hit]


def matches_in(segment: Segment, phrases: np.ndarray, lengths: np.ndarray, order: np.ndarray, slop: int):
    """Yield (phrase, start positions in the segment); a phrase stays inside one document.

    ``phrases`` holds term ids per phrase (padded with -1), ``order`` their offsets from the
    rarest term on.
    """
    terms, ids = phrases
    found = segment.find(terms)
    places = np.where(ids >= 0, found[ids], -2)
    # with slop, documents are set apart so far that no match reaches over an edge
    gap = slop and int(lengths.max()) + slop
    firsts = segment.firsts + gap * np.arange(len(segment.firsts))

    def positions(k):
        at = segment.positions(k)
        return at + gap * (np.searchsorted(segment.firsts, at, "right") - 1) if gap else at

    for p in np.flatnonzero((places != -1).all(axis=1)):
        starts = None
        for off in order[p, : lengths[p]]:
            shifted = positions(places[p, off]) - off
            starts = shifted if starts is None else _near(starts, shifted, slop)
            if not len(starts):
                break
        if starts is not None and len(starts):
            starts = starts[starts >= 0]
            doc = np.searchsorted(firsts, starts, "right") - 1
            doc_end = firsts[doc] + segment.firsts[doc + 1] - segment.firsts[doc]
            fits = starts + lengths[p] <= doc_end
            starts, doc = starts[fits], doc[fits]
            if len(starts):
                yield p, starts - gap * doc


MATCH = "segment long, place int, doc_id long, phrase long, start long, length int"
COVER = "segment long, place int, starts array<long>, ends array<long>, phrases array<long>"


def _term_counts(batches, terms):
    total = np.zeros(len(terms), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            seg = Segment(row | {"n_words": [], "postings": b""})
            at = seg.find(terms)
            sizes = np.diff(seg.ends, prepend=0)
            total[at >= 0] += sizes[at[at >= 0]]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(total)], ["term", "n"])


def _search(batches, terms, ids, lengths, order, numbers, slop):
    """Every match as a row."""
    for batch in batches:
        for row in batch.to_pylist():
            seg, docs = Segment(row), row["doc_ids"]
            for p, starts in matches_in(seg, (terms, ids), lengths, order, slop):
                place = np.searchsorted(seg.firsts, starts, "right") - 1
                columns = [
                    pa.array(np.full(len(starts), row["segment"])),
                    pa.array(place.astype(np.int32)),
                    pa.array([docs[k] for k in place], pa.int64()),
                    pa.array(np.full(len(starts), numbers[p])),
                    pa.array(starts - seg.firsts[place]),
                    pa.array(np.full(len(starts), lengths[p], np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "place", "doc_id", "phrase", "start", "length"])


def _cover(batches, terms, ids, lengths, order, numbers, slop):
    """Per document with a match: the merged word ranges covered, and the phrases matched."""
    for batch in batches:
        for row in batch.to_pylist():
            seg, phrases = Segment(row), {}
            change = np.zeros(seg.firsts[-1] + 1, np.int64)
            for p, starts in matches_in(seg, (terms, ids), lengths, order, slop):
                change[starts] += 1
                change[starts + lengths[p]] -= 1
                for place in np.unique(np.searchsorted(seg.firsts, starts, "right") - 1).tolist():
                    phrases.setdefault(place, []).append(int(numbers[p]))
            if not phrases:
                continue
            covered = np.cumsum(change)[:-1] > 0
            out = []
            for place, matched in phrases.items():
                own = np.r_[False, covered[seg.firsts[place] : seg.firsts[place + 1]], False].astype(np.int8)
                turns = np.diff(own)
                out.append((row["segment"], place, np.flatnonzero(turns > 0), np.flatnonzero(turns < 0), matched))
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int32(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["segment", "place", "starts", "ends", "phrases"],
            )


def _phrase_blocks(phrases: DataFrame, block_words: int):
    """The phrases in lists of at most ``block_words`` words in all (or one phrase)."""
    block, size = [], 0
    for row in phrases.select("phrase", "terms").toLocalIterator():
        if block and size + len(row["terms"]) > block_words:
            yield block
            block, size = [], 0
        block.append((row["phrase"], row["terms"]))
        size += len(row["terms"])
    if block:
        yield block


def _look_up(index, phrases, slop, block_words, task, schema) -> DataFrame:
    """Run ``task`` over the index, one pass for each bounded block of phrases."""
    spark, found = index.sparkSession, None
    for block in _phrase_blocks(phrases, block_words):
        numbers = np.array([p for p, _ in block], np.int64)
        lengths = np.array([len(t) for _, t in block])
        flat = np.concatenate([np.array(t, np.int64) for _, t in block]).view(np.uint64)
        terms, inverse = np.unique(flat, return_inverse=True)
        ids = np.full((len(block), lengths.max()), -1)
        ids[np.arange(lengths.max()) < lengths[:, None]] = inverse
        shared = spark.sparkContext.broadcast(terms)
        counted = index.select("terms", "ends").mapInArrow(lambda it, b=shared: _term_counts(it, b.value), "term long, n long")
        totals = np.zeros(len(terms), np.int64)
        for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
            totals[row["term"]] = row["n"]
        weight = np.where(ids >= 0, totals[ids], np.iinfo(np.int64).max)
        order = np.argsort(weight, axis=1, kind="stable")
        query = spark.sparkContext.broadcast((terms, ids, lengths, order, numbers, slop))
        part = index.mapInArrow(lambda it, b=query: task(it, *b.value), schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else stored(found, "matches")


def phrase_matches(index: DataFrame, phrases: DataFrame, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All places where ``phrases`` (phrase long, terms array<long> of word hashes) stand.

    Returns (segment, place, doc_id, phrase, start, length): the document's number in its
    segment, its id, and the word position in it.  Blocks of phrases are of bounded size, so
    what is broadcast is too.
    """
    return _look_up(index, phrases, slop, block_words, _search, MATCH)


def _item_words(batches):
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in text_blocks(batch.column(1)):
            words, first, _, _ = word_hashes(data, offsets, ALNUM)
            own = [words[first[i] : first[i + 1]].view(np.int64) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(own)), pa.array(own, pa.list_(pa.int64()))], ["item_id", "words"]
            )


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase, terms): all windows of all items; equal windows share a phrase number.

    An item with fewer words, but not none, is one window.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_item_words, "item_id string, words array<long>").filter(F.size("words") > 0)
    width = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - width + 1)
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("terms"))
    return rows.distinct().withColumn("phrase", F.xxhash64("terms"))


def _sums(batches):
    for batch in batches:
        hits = []
        for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            order = np.argsort(starts, kind="stable")
            starts, ends = np.array(starts)[order], np.maximum.accumulate(np.array(ends)[order])
            hits.append(int(np.maximum(ends - np.maximum(starts, np.r_[0, ends[:-1]]), 0).sum()))
        items = [sorted(own) for own in batch.column("items").to_pylist()]
        columns = [
            batch.column("segment"),
            batch.column("place"),
            pa.array(hits, pa.int64()),
            pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "place", "n_hit", "n_items", "items_sha256"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word inside any occurrence of an item's window is hit.  Null and empty texts have no
    words; repeated rows are each reported; rows of ``items`` that repeat an id are one item;
    windows of items without an id hit words but are not listed.  Other columns are not
    looked at.
    """
    index = build_index(docs, id_col, text_col)
    windows = stored(item_windows(items, window), "windows")
    phrases = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    found = _look_up(index, phrases, 0, block_words, _cover, COVER)
    spans = found.groupBy("segment", "place").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    listed = found.select("segment", "place", F.explode("phrases").alias("phrase")).join(windows.select("phrase", "item_id"), "phrase")
    listed = listed.groupBy("segment", "place").agg(F.collect_set("item_id").alias("items"))
    per_doc = spans.join(listed, ["segment", "place"]).mapInArrow(
        _sums, "segment long, place int, n_hit long, n_items long, items_sha256 string"
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "doc"))
    out = rows.join(per_doc, ["segment", "place"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
