"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w . x - b_k), with one weight vector ``w`` over hashed features shared
by all grades and ordered thresholds b_0 < b_1 < ...  Features are the words of a text
(letters and digits, A-Z folded; present or not) and its shape (shares of word endings, of
case and length classes, of words repeated at once), each under a 64-bit hash, so texts of
any length do not collide.  Training is stochastic gradient descent in numpy over a bounded
sample of rated documents, of which one task gets all hashes and counts, never texts; only
features whose frequency differs clearly between grades get a weight.  How clearly, and the
tail probability from which a document is kept, are chosen on a held-out third of the rated
rows: as many accepted documents as possible are to stay, and as few as possible of those of
any lower grade that hold a word telling them apart.  Every document is
scored in its own task from its whole text: expected grade, and tail probability
P(grade >= accepted) for selection.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .words import ALNUM, SPACED, mix, text_blocks, word_hashes

#: rated documents used for fitting, about, at most
TRAIN_ROWS = 6_000
#: chi-square values, with one degree of freedom, from which a feature is used: one of these
CLEAR = (18.0, 30.0, 50.0)
EPOCHS = 20
RATE = 3.0
SHRINK = 1e-3
#: an accepted document reaches this tail probability, where no better one can be told
THRESHOLD = 0.3
#: tail probabilities tried on the held-out rows, and how many rows a grade must have there
CUTS = np.arange(0.3, 0.96, 0.05)
ENOUGH = 5
#: a word tells lower grades apart when at most this share of its rows is accepted
TELLING = 0.05


def features(data: np.ndarray, offsets: np.ndarray):
    """(hash, row) of the words and of the shapes of a block of texts, and each row's words.

    Shapes are odd, words even.
    """
    n = len(offsets) - 1
    words, first, _, _ = word_hashes(data, offsets, ALNUM)
    word_rows = np.repeat(np.arange(n), np.diff(first))
    spaced, first, starts, ends = word_hashes(data, offsets, SPACED)
    rows = np.repeat(np.arange(n), np.diff(first))
    if len(spaced):
        upper = np.cumsum(np.r_[0, (data >= 0x41) & (data <= 0x5A)])
        kind = (np.minimum(upper[ends] - upper[starts], 3) * 8 + np.minimum(ends - starts, 7)).astype(np.uint64)
        tail = data[ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(ends - 2, starts)].astype(np.uint64)
        again = np.r_[False, (spaced[1:] == spaced[:-1]) & (rows[1:] == rows[:-1])]
        shapes = np.concatenate([tail + np.uint64(1 << 20), kind + np.uint64(1 << 21), np.full(int(again.sum()), 1 << 22, np.uint64)])
        shape_rows = np.concatenate([rows, rows, rows[again]])
    else:
        shapes, shape_rows = spaced, rows
    keys = np.concatenate([mix(words) & ~np.uint64(1), mix(shapes) | np.uint64(1)])
    return keys, np.concatenate([word_rows, shape_rows]), np.diff(first)


def values(keys: np.ndarray, counts: np.ndarray, n_words) -> np.ndarray:
    """1 for a word, the root of its share for a shape."""
    return np.where(keys & np.uint64(1), np.sqrt(counts / np.maximum(n_words, 1)), 1.0)


def _counted(batches):
    for batch in batches:
        ids, grades = batch.column(0), batch.column(1)
        for row, data, offsets in text_blocks(batch.column(2)):
            keys, rows, n_words = features(data, offsets)
            order = np.argsort(rows, kind="stable")
            keys, edges = keys[order], np.searchsorted(rows[order], np.arange(len(offsets)))
            out = []
            for i in range(len(offsets) - 1):
                own, n = np.unique(keys[edges[i] : edges[i + 1]], return_counts=True)
                out.append((own.astype("<u8").tobytes(), values(own, n, n_words[i]).astype("<f4").tobytes()))
            which, share = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(out)), grades.slice(row, len(out)), pa.array(which, pa.binary()), pa.array(share, pa.binary())],
                ["doc_id", "grade", "which", "share"],
            )


@dataclass
class Grader:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: per k the tail P(grade > k) from which a document counts as above k
    cuts: np.ndarray | None = None

    def cut(self, accepted: int) -> float:
        return THRESHOLD if self.cuts is None else float(self.cuts[accepted - 1])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, one row a score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w . x of every text of a block."""
        n = len(offsets) - 1
        keys, rows, n_words = features(data, offsets)
        if not len(self.keys) or not len(keys):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        used = self.keys[at] == keys
        pair, counts = np.unique(rows[used] * len(self.keys) + at[used], return_counts=True)
        own, at = np.divmod(pair, len(self.keys))
        x = values(self.keys[at], counts, n_words[own])
        return np.bincount(own, weights=x * self.weights[at], minlength=n)


def clear_features(rows, grades: int, clear: float = CLEAR[0]) -> np.ndarray:
    """Features whose presence, or mean value for shapes, tells some grade from the ones below."""
    keys, inverse = np.unique(np.concatenate([w for _, w, _ in rows]), return_inverse=True)
    grade = np.repeat([g for g, _, _ in rows], [len(w) for _, w, _ in rows])
    x = np.concatenate([s for _, _, s in rows]).astype(float)
    best = np.zeros(len(keys))
    all_grades = np.array([g for g, _, _ in rows])
    for k in range(1, grades):
        high = (all_grades >= k).sum()
        low = len(rows) - high
        if not high or not low:
            continue
        sums = [np.bincount(inverse[side], weights=x[side], minlength=len(keys)) for side in (grade < k, grade >= k)]
        squares = np.bincount(inverse, weights=x * x, minlength=len(keys))
        mean = (sums[0] + sums[1]) / len(rows)
        spread = np.maximum(squares / len(rows) - mean**2, 1e-12) * (1 / low + 1 / high)
        best = np.maximum(best, (sums[0] / low - sums[1] / high) ** 2 / spread)
    often = np.bincount(inverse, minlength=len(keys)) >= 5
    return keys[often & (best >= clear)]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = EPOCHS, rate: float = RATE, clear: float = CLEAR[0]) -> Grader:
    """Train on (grade, features, values); the order is fixed by a seed."""
    rng = np.random.default_rng(3)
    keys = clear_features(rows, grades, clear)
    b = np.linspace(-1, 1, grades - 1)
    w, square = np.zeros(len(keys)), np.full(len(keys), 1e-8)
    inputs = []
    for grade, which, x in rows:
        at = np.minimum(np.searchsorted(keys, which), max(len(keys) - 1, 0))
        used = keys[at] == which if len(keys) else np.zeros(len(which), bool)
        inputs.append((grade, at[used], x[used].astype(float)))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(inputs)):
            grade, at, x = inputs[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x - b, -30, 30)))
            error = (np.arange(grades - 1) < grade) - p
            slope = error.sum() * x - SHRINK * w[at]
            square[at] += slope * slope
            w[at] += step * slope / np.sqrt(square[at])
            b = np.maximum.accumulate(b - 0.1 * step * error)
    return Grader(keys, w, b)


def telling_words(rows, grades: int) -> list[np.ndarray]:
    """Per k the clearest words of which nearly no row has a grade above k."""
    keys = np.zeros(0, np.uint64)
    for clear in reversed(CLEAR):
        keys = clear_features(rows, grades, clear)
        keys = keys[(keys & np.uint64(1)) == 0]
        if len(keys):
            break
    above = np.zeros((grades, len(keys)))
    for grade, which, _ in rows:
        above[: grade + 1, np.isin(keys, which)] += 1
    return [keys[above[k + 1] <= TELLING * above[0]] for k in range(grades - 1)]


def chosen_cuts(grader: Grader, held, words: list[np.ndarray], grades: int) -> tuple[np.ndarray, float]:
    """Cuts for every k on held-out rows, and what they gain in all.

    The gain is twice the share of higher rows kept (what is lost there is lost for good) less
    the share kept of the lower grade that is kept most, counting of the lower rows those
    with a telling word.  The cut is the lowest whose gain is within one standard error of the
    best, as a higher one costs sound rows for what may be chance.
    """
    scores = np.zeros(len(held))
    for i, (_, which, x) in enumerate(held):
        own = np.isin(which, grader.keys)
        scores[i] = grader.weights[np.searchsorted(grader.keys, which[own])] @ x[own].astype(float)
    tails, grade = grader.tails(scores), np.array([g for g, _, _ in held])
    cuts, total = np.full(grades - 1, THRESHOLD), 0.0
    for k in range(grades - 1):
        told = np.array([np.isin(which, words[k]).any() for _, which, _ in held])
        lower = [m for m in ((grade == g) & told for g in range(k + 1)) if m.sum() >= ENOUGH]
        if not lower or (grade > k).sum() < ENOUGH:
            continue
        kept = tails[:, k, None] >= CUTS
        left = np.max([kept[m].mean(axis=0) for m in lower], axis=0)
        gain, n = 2 * kept[grade > k].mean(axis=0) - left, min(m.sum() for m in lower)
        p = (left[gain.argmax()] * n + 1) / (n + 2)
        cuts[k] = CUTS[(gain >= gain.max() - np.sqrt(p * (1 - p) / n)).argmax()]
        total += gain.max()
    return cuts, total


def fit_and_cut(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int) -> Grader:
    """Train on all rows, with the selection and the cuts that do best on a held-out third."""
    part = np.random.default_rng(4).permutation(len(rows)) % 3
    first, held = ([r for r, p in zip(rows, part, strict=True) if (p == 0) == side] for side in (False, True))
    cuts, clear = np.full(grades - 1, THRESHOLD), CLEAR[0]
    if first and held:
        words, best = telling_words(first, grades), -np.inf
        for value in CLEAR:
            found, gain = chosen_cuts(fit(first, grades, clear=value), held, words, grades)
            if gain > best:
                cuts, clear, best = found, value, gain
    grader = fit(rows, grades, clear=clear)
    grader.cuts = cuts
    return grader


def _trained(batches, grades):
    """One row: the grader fitted to all the sample's rows, whose order does not matter."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    if rows:
        rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["grade"], r["which"]))
        found = fit_and_cut([(r["grade"], np.frombuffer(r["which"], "<u8"), np.frombuffer(r["share"], "<f4")) for r in rows], grades)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])


def train_grader(rated: DataFrame, grades: int, id_col="doc_id", grade_col="grade", text_col="text", rows: int = TRAIN_ROWS) -> Grader:
    """Fit on about ``rows`` rated documents, drawn by a hash of id and text; on all where there are fewer.

    Rows without a grade or with one outside 0 .. grades-1 are not used, rows that agree in id,
    grade and text count once.  With no rated rows the grader is neutral and accepts
    everything.  The fitting runs in one task; the driver gets the weights.
    """
    small_batches(rated.sparkSession)
    used = rated.filter(F.col(grade_col).between(0, grades - 1))
    used = used.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = used.select("doc_id").count()
    if n > rows:
        used = used.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int((1 << 20) * rows / n)))
    counted = used.dropDuplicates().mapInArrow(_counted, "doc_id long, grade int, which binary, share binary")
    found = counted.repartition(1).mapInArrow(lambda it: _trained(it, grades), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Grader(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, -60.0))


def _graded(batches, shared, accepted):
    grader = shared.value
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in text_blocks(batch.column(1)):
            n = len(offsets) - 1
            tails = grader.tails(grader.scores(data, offsets))
            columns = [ids.slice(row, n), pa.array(tails.sum(axis=1)), pa.array(tails[:, accepted - 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail"])


def grade(docs: DataFrame, grader: Grader, accepted: int, id_col="doc_id", text_col="text", threshold: float | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for every row: tail is P(grade >= accepted).

    Kept is what reaches ``threshold``, by default the grader's own cut.

    A null text is an empty one, which has no feature: its grade follows from the
    thresholds alone.  Repeated rows are each graded; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grader)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda it: _graded(it, shared, accepted), "doc_id long, expected_grade double, tail double")
    return out.withColumn("kept", F.col("tail") >= (grader.cut(accepted) if threshold is None else threshold))


def keep_graded(docs: DataFrame, grader: Grader, accepted: int, text_col="text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are accepted; columns unchanged, one pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grader)
    columns, least = docs.columns, grader.cut(accepted) if threshold is None else threshold

    def chosen(batches):
        for batch in batches:
            texts = batch.column(columns.index(text_col)).cast(pa.large_string()).fill_null("")
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), texts], ["doc_id", "text"])
            tail = np.concatenate([np.asarray(b.column("tail")) for b in _graded([pair], shared, accepted)] or [np.zeros(0)])
            yield batch.filter(pa.array(tail >= least))

    return docs.mapInArrow(chosen, docs.schema)


def ratings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a grade from two judgments: 0 of low quality, 1 sound but toxic, 2 sound.

    Labels with a null in either judgment or in the id are not used; where an id is labelled
    more than once the lowest grade counts.
    """
    known = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    graded = labels.select("doc_id", known.alias("grade")).filter("doc_id is not null and grade is not null")
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return docs.select("doc_id", "text").join(graded, "doc_id")
