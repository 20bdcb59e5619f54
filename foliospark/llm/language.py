"""Language identification from averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 1 to 4 letters, told apart by
where in a word they stand, hashed into a table); a linear layer and a softmax give the languages'
probabilities.  Embeddings and layer are trained together by stochastic gradient descent in
numpy, on hashed counts of a bounded sample of labelled rows.  The sample holds as many rows of
each language, or all it has, so a rare language is learned at any size of the corpus; the
shares in the corpus come back as priors.  A part of the sample is set aside to calibrate, each row
weighing as many as it stands for: one temperature makes the probabilities honest, and the
rejection bound is the lowest at which the accepted part reaches the wanted precision.

Prediction reads whole texts.  The mean of embeddings times the layer is the mean of
(embedding times layer), so each subword costs one look-up of a few numbers.
"""

from __future__ import annotations

import pickle
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
WIDTH = 16
#: labelled rows used for training and calibration, at most
TRAIN_ROWS = 8_000
EPOCHS = 5
RATE = 0.2
PRECISION = 0.99
UNKNOWN = "und"
BLOCK_CHARS = 1 << 19


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form (one code point), and whether it is a letter."""
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            letter[c] = True
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    return lower, letter


def subwords(texts: list[str]):
    """Hashed subwords of a block of texts: (bucket, row), and whether each text has a letter.

    Only letters count; anything else ends a word.
    """
    lower, letter = _classes()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    rows = np.searchsorted(ends, np.arange(len(points)), "right")
    inside = letter[points]
    has = np.bincount(rows[inside], minlength=len(texts)) > 0
    code = np.where(inside, lower[points], 0).astype(np.uint64)
    out, owners = [], []
    # the run of n characters from each place on, grown by one character at a time; a run that
    # starts a word, or is followed by no letter, is told apart from one inside
    opens = inside & ~np.r_[False, inside[:-1]]
    size = len(code)
    value, alive = np.zeros(size, np.uint64), np.ones(size, bool)
    inside, code = np.r_[inside, np.zeros(5, bool)], np.r_[code, np.zeros(5, np.uint64)]
    for n in range(1, 5):
        alive = alive & inside[n - 1 : size + n - 1]
        value = value * np.uint64(1_000_003) + code[n - 1 : size + n - 1]
        at = np.flatnonzero(alive)
        closes = ~inside[at + n]
        mark = value[at] + opens[at] * np.uint64(0x9E3779B1) + closes * np.uint64(0x85EBCA77) + np.uint64(n)
        mark = (mark ^ (mark >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mark >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
        owners.append(rows[at])
    return np.concatenate(out), np.concatenate(owners), has


def _blocks(texts: list[str]):
    """Runs of rows of bounded length, or one row."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _counted(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in _blocks(texts):
            which, rows, _ = subwords(texts[a:b])
            order = np.argsort(rows, kind="stable")
            which, edges = which[order], np.searchsorted(rows[order], np.arange(b - a + 1))
            out = []
            for i in range(b - a):
                own, n = np.unique(which[edges[i] : edges[i + 1]], return_counts=True)
                out.append((own.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
            which, times = zip(*out, strict=True)
            columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(which, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "which", "times"])


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # bucket x language: embedding times layer
    bias: np.ndarray
    temperature: float
    bound: float

    def probabilities(self, which: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """One row of probabilities for each text; uniform where it has no subword."""
        counts = np.maximum(np.bincount(rows, minlength=n), 1)
        means = [np.bincount(rows, weights=self.table[which, k], minlength=n) / counts for k in range(len(self.names))]
        return softmax((np.stack(means, axis=1) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrate(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest score whose accepted rows reach ``precision``."""
    if not len(truth):
        return 1.0, 0.5
    heats = np.geomspace(0.05, 10, 60)
    loss = [-np.average(np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)), weights=weight) for t in heats]
    best = float(heats[int(np.argmin(loss))])
    p = softmax(logits / best)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top, kind="stable")
    enough = np.cumsum((right * weight)[order]) >= precision * np.cumsum(weight[order])
    return best, float(top[order][np.flatnonzero(enough)[-1]]) if enough.any() else 1.0


def fit(rows, stands: dict[str, float] | None = None, epochs: int = EPOCHS, rate: float = RATE, precision: float = PRECISION) -> Languages:
    """Train on (language, subwords, their counts); a row of a language stands for ``stands`` rows.

    Every fifth row, in the given order, is kept for calibration.
    """
    names = sorted({lang for lang, _, _ in rows})
    stands = stands or {}
    rng = np.random.default_rng(11)
    embed, layer, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(names))), np.zeros(len(names))
    number = {n: i for i, n in enumerate(names)}
    rows = [(lang, which, times / max(times.sum(), 1)) for lang, which, times in rows]
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    used = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(used)):
            lang, which, share = used[i]
            if not len(which):
                continue
            mean = share @ embed[which]
            error = softmax(mean @ layer + bias)
            error[number[lang]] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # the step of a table row counts its occurrences, relative to the text's length
            embed[which] -= step * 20 * np.outer(share, back)
    # a language drawn more sparsely than others is more likely than the sample says
    weight = np.array([stands.get(n, 1.0) for n in names])
    bias = bias + np.log(weight / weight.mean()) if len(names) else bias
    model = Languages(names, embed @ layer, bias, 1.0, 0.0)
    logits = np.array([share @ model.table[w] + bias if len(w) else bias for _, w, share in held]).reshape(-1, len(names))
    truth = np.array([number[lang] for lang, _, _ in held], int)
    model.temperature, model.bound = _calibrate(logits, truth, weight[truth], precision)
    return model


def level(counts: list[int], rows: int) -> int:
    """The most rows a language may give so that all together give about ``rows``, at least 1."""
    left = rows
    for i, n in enumerate(sorted(counts)):
        share = max(1, left // (len(counts) - i))
        if n > share:
            return share
        left -= n
    return max([1, *counts])


def _trained(batches, stands):
    """One row: the model fitted to all the sample's rows, whose order does not matter."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    if rows:
        rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["which"], r["times"]))
        model = fit([(r["lang"], np.frombuffer(r["which"], "<u4"), np.frombuffer(r["times"], "<u4").astype(float)) for r in rows], stands)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train_languages(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows: int = TRAIN_ROWS) -> Languages | None:
    """Fit on about ``rows`` labelled rows, as many of each language or all it has; None without any.

    Rows are drawn by a hash of id and text; rows that agree in id, language and text count once.
    The fitting runs in one task; the driver gets the rows per language and the model.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    most = level(list(counts.values()), rows)
    stands = {lang: max(1.0, n / most) for lang, n in counts.items()}
    if sum(counts.values()) > rows:
        # a constant of the plan, as a join would deal all texts by language
        rate = F.create_map(*[F.lit(x) for lang, s in stands.items() for x in (lang, int((1 << 20) / s))])
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.try_element_at(rate, F.col("lang")))
    counted = labelled.select("doc_id", "lang", "text").dropDuplicates().mapInArrow(_counted, "doc_id long, lang string, which binary, times binary")
    found = counted.repartition(1).mapInArrow(lambda it: _trained(it, stands), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _predicted(batches, shared):
    model = shared.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in _blocks([t or "" for t in texts]):
            own = [t or "" for t in texts[a:b]]
            which, rows, has = subwords(own)
            p = model.probabilities(which, rows, b - a)
            best = p.argmax(axis=1)
            score = np.where(has, p[np.arange(b - a), best], 0.0)
            names = [model.names[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)]
            columns = [batch.column(0).slice(a, b - a), pa.array(names), pa.array(score), pa.array(has & (score >= model.bound))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "accepted"])


def predict(docs: DataFrame, model: Languages | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or there was nothing to
    learn from.  ``accepted`` is false where the score is below the calibrated bound.
    Repeated rows are each predicted; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _predicted(it, shared), "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(id_col="doc_id"):
    """Whether a row is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learned from the rows not held out."""
    model = train_languages(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out("doc_id")).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted"
    )
