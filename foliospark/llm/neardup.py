"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact check.

Steps, all Spark jobs:

1. Every text becomes a set of 5-word runs (A-Z folded), a MinHash signature and one key per
   band.  Equal word sequences are one node (smallest doc_id), so a group of exact copies of
   any size costs one node.
2. Nodes sharing a band key are candidates.  Inside a bucket nodes are first compared with
   the bucket's pivot only: the node that shares most buckets with others, so the one nearest
   to the middle of its group.  What this links is merged.
3. A pair's signatures are read in batches.  After each batch the pair is dropped when the
   posterior probability (uniform prior, binomial likelihood) that its similarity reaches the
   threshold is below ``miss``.  Batches never accept a pair.
4. Survivors are confirmed on the full sets with integer arithmetic.
5. Pairs of a bucket that lie in different components still have to be compared, but not all
   with all.  Every node is described by its difference from the pivot: the runs it adds and
   those it lacks.  Of two such nodes one at least is not linked with the pivot, so a linked pair
   differs from the pivot in the same way for more than half of the nearer one's difference.
   Hence it shares a run in the first half of the one's differences and the first of the
   other's, in any order both keep (``prefix_lengths``).  The order puts the rarest first, as
   counted on a sample of the group, so what a whole group shares comes last and near copies
   that differ each in its own way meet no partner.  A join on (pivot, differing run) with the
   bounds on sizes and positions proposes the pairs, and steps 3 and 4 verify them.  Nothing is
   lost: a wrong count only makes the order worse.

With 28 bands of 5 rows a pair of similarity 0.85 shares no band with probability 7e-8.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, stored
from .words import SPACED, mix, shingles, text_blocks, word_hashes

BANDS = 28
ROWS = 5
BATCH = 20
MISS = 1e-6

_rng = np.random.default_rng(5)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEQ = _rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(runs: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set of run hashes."""
    low = (runs >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = (low[at : at + 2048, None] ^ _FLIP) * _TIMES
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((bands * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def sequence_key(words: np.ndarray) -> list[int]:
    """Two 64-bit hashes of a word sequence, order included."""
    if not len(words):
        return [0, 0]
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    return [int(mix(mix(words + at * k) + k).sum(dtype=np.uint64).view(np.int64)) for k in _SEQ]


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _sketch(batches, width):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for row, data, offsets in text_blocks(texts):
            words, first, _, _ = word_hashes(data, offsets, SPACED)
            out = []
            for i in range(len(offsets) - 1):
                own = words[first[i] : first[i + 1]]
                runs = shingles(own, width)
                sig = signature(runs) if len(runs) else None
                out.append(
                    (
                        len(runs),
                        *sequence_key(own),
                        None if sig is None else sig.astype(np.uint16).tobytes(),
                        None if sig is None else band_keys(sig),
                    )
                )
            n, k1, k2, sig, bands = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, len(out)),
                    pa.array(n, pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.array(sig, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
            )


@lru_cache(maxsize=64)
def least_matches(percent: int, batch: int, total: int, miss: float) -> tuple[int, ...]:
    """For n = batch, 2*batch, ... the fewest of n equal values that keep a pair.

    With m of n equal and a uniform prior the similarity is Beta(m+1, n-m+1); its chance to
    reach t is the chance of at most m successes in n+1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        chance, tail, m = (1 - t) ** (n + 1), 0.0, 0
        for m in range(n + 2):
            tail += chance
            if tail >= miss:
                break
            chance *= (n + 1 - m) / (m + 1) * t / (1 - t)
        out.append(m)
    return tuple(out)


def _prune(batches, percent, miss):
    least = least_matches(percent, BATCH, BANDS * ROWS, miss)
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sig_a", "sig_b"))
        alive = np.arange(len(a))
        left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
        right = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
        equal = np.zeros(len(a), np.int64)
        for k, need in enumerate(least):
            at = slice(k * BATCH, (k + 1) * BATCH)
            equal[alive] += (left[alive, at] == right[alive, at]).sum(axis=1)
            alive = alive[equal[alive] >= need]
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _zipped(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        out = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "z"])


def _confirm(batches, percent, width):
    unpack = zstandard.ZstdDecompressor()
    recent: dict[bytes, np.ndarray] = {}

    def runs(z):
        if z not in recent:
            if len(recent) > 64:
                recent.clear()
            data = np.frombuffer(unpack.decompress(z), np.uint8)
            words, _, _, _ = word_hashes(data, np.array([0, len(data)]), SPACED)
            recent[z] = shingles(words, width)
        return recent[z]

    for batch in batches:
        names = batch.schema.names
        za, zb = (batch.column(names.index(c)) for c in ("z_a", "z_b"))
        good = []
        for i in range(batch.num_rows):
            x, y = runs(za[i].as_py()), runs(zb[i].as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                good.append(i)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def prefix_lengths(a, size, pivot, percent: int):
    """How many of its ``a`` differences from a pivot a node must show: as the nearer one, as the far one.

    Sets x, y are linked when their difference is at most q (x + y), q = (100 - percent) / (100 +
    percent).  With differences a, b from the pivot p they share s = (a + b - difference) / 2 of
    them.  If y is not linked with p, b > q (y + p), so s > (a + q (p - x)) / 2.  Also a is at least b
    less the pair's difference, so s >= b - q (x + y), where x <= 100 y / percent.  Of two sets
    that share s members, the first len - s + 1 members in a common order share one.
    """
    whole, less = 100 + percent, 100 - percent
    near = (a * whole + less * (pivot - size)) // (2 * whole) + 1
    far = -(-(a * whole * percent - less * size * whole) // (whole * percent))
    return np.maximum(a - near + 1, 0), a - np.maximum(far, 1) + 1


_LACKED = np.uint64(0x9E6C63D0876A9A47)
PREFIX = "pivot long, run long, node long, label long, far boolean, a long, size long, place long, near_one boolean, far_one boolean"


def _differences(batches, percent, width, whole):
    """Prefix rows of (node, pivot) pairs; with ``whole``, all differences in any order."""
    unpack, runs = zstandard.ZstdDecompressor(), {}

    def shown(z):
        if z not in runs:
            if len(runs) > 64:
                runs.clear()
            data = np.frombuffer(unpack.decompress(z), np.uint8)
            runs[z] = shingles(word_hashes(data, np.array([0, len(data)]), SPACED)[0], width)
        return runs[z]

    names = [f.split()[0] for f in PREFIX.split(", ")]
    held, size = [], 0

    def block():
        differ, same = zip(*held, strict=True)
        n = np.array([len(d) for d in differ])
        pivot, node, label, far, a, own, near, long_ = (np.repeat(v, n) for v in zip(*same, strict=True))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = np.concatenate(differ).view(np.int64)
        columns = [pivot, run, node, label, far, a, own, place, place < near, place < long_]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    for batch in batches:
        rows = (batch.column(c).to_pylist() for c in ("pivot", "node", "label", "far", "z_a", "z_b", "common"))
        for pivot, node, label, far, own, other, common in zip(*rows, strict=True):
            x, p = shown(own), shown(other)
            differ = np.concatenate([np.setdiff1d(x, p, True), np.setdiff1d(p, x, True) ^ _LACKED])
            a = len(differ)
            if common:
                # rarest first: what the sample did not show often, then by its count there
                known = np.frombuffer(common, "<u8").reshape(-1, 2)
                at = np.minimum(np.searchsorted(known[:, 0], differ), len(known) - 1)
                often = np.where(known[at, 0] == differ, known[at, 1], 0)
                differ = differ[np.lexsort((differ, often))]
            else:
                differ.sort()
            near, long_ = (int(v) for v in prefix_lengths(a, len(x), len(p), percent))
            long_ = long_ if far else 0
            n = a if whole else max(near, long_)
            if n:
                held.append((differ[:n], (pivot, node, label, far, a, len(x), near, long_)))
                size += n
            if size > 1 << 17:
                yield block()
                held, size = [], 0
    if held:
        yield block()


#: one node in so many of a pivot's group is looked at for the order, and the share that makes a run common
SAMPLE, COMMON = 8, 32


def _proposed(rows, texts, percent, width):
    """Pairs (a, b) of nodes with different labels that may be linked, of ``rows`` (node, pivot, label, far)."""
    z = rows.join(texts.toDF("node", "z_a"), "node").join(texts.toDF("pivot", "z_b"), "pivot")
    sample = z.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).withColumn("common", F.lit(None).cast("binary"))
    seen = sample.mapInArrow(lambda it: _differences(it, percent, width, True), PREFIX)
    size = rows.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("pivot").agg(F.countDistinct("node").alias("nodes"))
    counts = seen.groupBy("pivot", "run").agg(F.count("*").alias("n")).filter("n > 1").join(size, "pivot").filter(F.col("n") * COMMON >= F.col("nodes"))
    # per pivot (run, count) pairs, sorted by run as unsigned numbers; at most COMMON times a mean difference
    one = F.struct(F.col("run").bitwiseXOR(F.lit(-(1 << 63))).alias("by"), "run", "n")
    flip = F.transform(F.sort_array(F.collect_list(one)), lambda r: F.array(r["run"], r["n"]))
    common = counts.groupBy("pivot").agg(F.flatten(flip).alias("common"))
    common = stored(common, "common")
    full = z.join(common, "pivot", "left")
    prefix = stored(full.mapInArrow(lambda it: _differences(_packed_common(it), percent, width, False), PREFIX), "prefix")
    one = prefix.filter("near_one").select("pivot", "run", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "far", "a", "size", "place")])
    two = prefix.filter("far_one").select("pivot", "run", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "a", "size", "place")])
    whole, less = 100 + percent, 100 - percent
    both = F.col("x_size") + F.col("y_size")
    shared = whole * (F.col("x_a") + F.col("y_a")) - less * both
    left = F.least(F.col("x_a") - F.col("x_place"), F.col("y_a") - F.col("y_place"))
    order = F.struct("x_a", "x_node") < F.struct(F.col("y_a").alias("x_a"), F.col("y_node").alias("x_node"))
    fits = (
        (one["pivot"] == two["pivot"])
        & (one["run"] == two["run"])
        & (F.col("x_label") != F.col("y_label"))
        & (~F.col("x_far") | order)
        & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
        & (whole * F.abs(F.col("x_a") - F.col("y_a")) <= less * both)
        & (2 * whole * left >= shared)
    )
    pairs = one.join(two, fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    return pairs.distinct()


def _packed_common(batches):
    """The list column ``common`` as bytes."""
    for batch in batches:
        at = batch.schema.get_field_index("common")
        data = [v.values.to_numpy().astype("<i8").tobytes() if v.is_valid else None for v in batch.column(at)]
        yield batch.set_column(at, "common", pa.array(data, pa.binary()))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node in them.

    Smallest-label spreading with label jumps; each round is written, and the driver sees
    one number a round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label"))
        step = stored(step, "labels")
        moved = step.filter("label < old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def _check(pairs, nodes, texts, percent, width, miss):
    """Pairs (a, b) of nodes whose full sets reach the similarity."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    alive = both.mapInArrow(lambda it: _prune(it, percent, miss), "a long, b long")
    full = alive.join(texts.toDF("a", "z_a"), "a").join(texts.toDF("b", "z_b"), "b")
    return stored(full.mapInArrow(lambda it: _confirm(it, percent, width), "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    width: int = 5,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Two texts are linked when 100 * shared runs >= percent * all runs.  Null and empty texts
    have no runs and are linked with nothing.  Rows with a null id keep their own row,
    have a null component_id, and are kept.  Rows that repeat an id are one node,
    linked with whatever any of their texts is linked with.  Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(picked.mapInArrow(lambda it: _sketch(it, width), SKETCH), "sketch")
    full = rows.filter("doc_id is not null and n_shingles > 0")

    # one node for each word sequence; n counts its copies
    groups = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    groups = stored(groups, "groups")
    first = full.join(groups, (full["doc_id"] == groups["node"]) & (full["k1"] == groups["k1"]) & (full["k2"] == groups["k2"]))
    nodes = first.select("node", "n", groups["k1"], groups["k2"], "sig", "bands").dropDuplicates(["node", "k1", "k2"])

    rows_of = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = rows_of.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("held"))
    shared = stored(rows_of.join(sizes.filter("lo < hi").select("bucket", "held"), "bucket"), "shared")
    met = shared.groupBy("node").agg(F.sum("held").alias("met"))
    best = F.max(F.struct("met", "n", (-F.col("node")).alias("m"))).alias("best")
    pivots = shared.join(met, "node").groupBy("bucket").agg(best).select("bucket", (-F.col("best.m")).alias("pivot"))
    members = stored(shared.select("bucket", "node").join(pivots, "bucket"), "members")
    wanted = members.select("node").distinct()
    nodes = stored(nodes.join(wanted, "node", "left_semi").select("node", "sig"), "nodes")
    zipped = picked.filter("doc_id is not null").mapInArrow(_zipped, "node long, z binary")
    texts = stored(zipped.join(wanted, "node", "left_semi").dropDuplicates(["node", "z"]), "texts")

    spokes = members.filter("node <> pivot").select("node", "pivot").distinct()
    pairs = spokes.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    links = _check(stored(pairs.distinct(), "pairs"), nodes, texts, percent, width, miss)
    labels = components(links)

    # pairs without the pivot, in buckets where not all others are in one component
    held = members.filter("node <> pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    open_rows = held.join(split.select("bucket"), "bucket").select("node", "pivot", "label").distinct()
    linked = links.select(F.col("a").alias("node"), F.col("b").alias("pivot")).union(links.select("b", "a")).withColumn("linked", F.lit(True))
    open_rows = open_rows.join(linked, ["node", "pivot"], "left").select("node", "pivot", "label", F.col("linked").isNull().alias("far"))
    found = _check(stored(_proposed(stored(open_rows, "open"), texts, percent, width), "pairs"), nodes, texts, percent, width, miss)
    labels = components(links.union(found))

    groups = groups.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component"))
    out = rows.join(groups, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
