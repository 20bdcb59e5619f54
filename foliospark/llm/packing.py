"""Best-fit decreasing: documents packed into as few sequences of ``capacity`` tokens as it can.

1. Texts are encoded once; a text longer than the capacity is cut into pieces.  Each task numbers
   its pieces of one length as it goes, and the pieces are written with their ids.
2. Pieces of one length are interchangeable, so best-fit decreasing needs only how many there
   are of each length: at most ``capacity`` rows however large the corpus.  One task packs that
   table: lengths from the longest down, the tightest open bin found in a segment tree over the
   remaining capacities.  Bins with equal rest are moved together as ranges of bin numbers, so
   the steps are bounded by the lengths, not by the documents.  The result is a plan of ranges:
   the k-th piece of a length goes to this bin at this offset.
3. A piece's number k is its number in its task plus the counts of the tasks before; with it
   the plan gives the place of every piece, the same as packing one document at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .tokens import END_ID, encoder

CAPACITY = 4096
HELD_BYTES = 1 << 23

PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids binary"


def _pieces(batches, vocabulary, end_id, capacity):
    """Rows of pieces; ``nth`` counts the task's pieces of one length, ids are little-endian uint32."""
    enc, part = encoder(vocabulary, end_id), TaskContext.get().partitionId()
    seen = [0] * (capacity + 1)
    rows, held = [], 0

    def block():
        columns = zip(*rows, strict=True)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), *arrays], ["part", "nth", "doc_id", "piece", "start", "length", "ids"]
        )

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            encoded = enc.encode([t or "" for t in texts.slice(at, 256).to_pylist()])
            wide = np.frombuffer(b"".join(encoded), enc.dtype).astype("<u4").tobytes()
            place = 0
            for doc, own in zip(ids[at : at + 256], encoded, strict=True):
                n = len(own) // enc.dtype.itemsize
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((seen[length], doc, piece, start, length, wide[place : place + 4 * length]))
                    seen[length] += 1
                    place += 4 * length
                    held += 4 * length
                if held >= HELD_BYTES:
                    yield block()
                    rows, held = [], 0
    if rows:
        yield block()


class OpenBins:
    """Ranges of open bins by remaining capacity, and a segment tree that tells which are not empty."""

    def __init__(self, capacity: int):
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)

    def _mark(self, rest: int):
        at = self.leaves + rest
        self.tree[at] = bool(self.ranges[rest])
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def put(self, rest: int, first: int, bins: int):
        if rest and bins:
            self.ranges[rest].append((first, bins))
            self._mark(rest)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = self.leaves + length
        while not self.tree[at]:
            # on to the next subtree on the right, upwards from a right child
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, rest: int) -> tuple[int, int]:
        found = self.ranges[rest].pop()
        self._mark(rest)
        return found


def best_fit(lengths: list[tuple[int, int]], capacity: int = CAPACITY):
    """Yield (length, lo, hi, bin, each, base) for (length, count) pairs, each length given once.

    Of the pieces of a length, numbers lo to hi - 1 fill bins from ``bin`` on, ``each`` to a
    bin, the first of them at offset ``base``.
    """
    bins, opened = OpenBins(capacity), 0
    for length, left in sorted(lengths, reverse=True):
        lo = 0
        while left:
            rest = bins.tightest(length)
            if rest is None:
                rest, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = bins.take(rest)
            # a bin just filled is the tightest for the next piece of the length, while one fits
            each = rest // length
            full = min(many, left // each)
            for count, k in ((full, each), (int(full < many), left - full * each)):
                if count and k:
                    yield length, lo, lo + count * k, first, k, capacity - rest
                    bins.put(rest - k * length, first, count)
                    lo, left, first, many = lo + count * k, left - count * k, first + count, many - count
                if not left or not many:
                    break
            bins.put(rest, first, many)


PLAN = "length long, lo long, hi long, first long, each long, base long"


def _plan(frames, capacity):
    rows = [row for frame in frames for row in zip(frame["length"].tolist(), frame["n"].tolist(), strict=True)]
    yield pd.DataFrame(list(best_fit(rows, capacity)), columns=[c.split()[0] for c in PLAN.split(", ")], dtype="int64")


def packed(
    docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, ids), one row per piece of a document.

    ``ids`` are the piece's token ids as little-endian uint32.  A null or empty text is its end
    id alone.  Repeated rows and null ids are documents of their own; an empty table gives no
    rows; other columns are not looked at.  ``sequence_rows`` puts the sequences together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(lambda it: _pieces(it, vocabulary, end_id, capacity), PIECES), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))
    plan = stored(lengths.coalesce(1).mapInPandas(lambda it: _plan(it, capacity), PLAN), "plan")
    # running totals over tasks, length by length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    k = F.col("before") + F.col("nth")
    numbered = pieces.join(before, ["part", "length"]).withColumn("k", k)
    step = plan.withColumnRenamed("length", "size")
    placed = numbered.join(step, (F.col("length") == F.col("size")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    sequence = (F.col("first") + F.expr("(k - lo) div each")).alias("sequence_id")
    offset = (F.col("base") + F.expr("(k - lo) % each") * F.col("length")).alias("offset")
    return placed.select("doc_id", "piece", "start", "length", sequence, offset, "ids")


def sequence_rows(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; a group holds at most the capacity."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(own, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
