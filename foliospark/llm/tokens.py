"""Token ids of documents in Arrow files of equal-length sequences.

A shard is one range of doc_id, encoded and written by one task as two Arrow IPC files (the
stream layout plus a footer, uncompressed):

* sequences: ``input_ids fixed_size_list<uint16|uint32, L>`` and ``mask fixed_size_list<uint8, L>``.
  Documents follow one another without gaps; the last sequence of a shard is padded and its
  mask is 0 there, else 1.  Masks are bytes, as Arrow packs booleans into bits, which no array can view.  Every batch but the last has the same number of rows, so sequence i
  is row i % rows of batch i // rows, and a memory-mapped read copies nothing.
* documents: ``doc_id, start, n_tokens``, start counted within the shard.

Every attempt of a task writes names of its own and reports them in a manifest row; the
manifest is an ordinary written table, so a lost or repeated task leaves only unused files.

Documents are encoded word by word with a bounded cache: the tokenizer drops white space
before its merges, so the ids of a text are the ids of its space-separated pieces in turn.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_store, output_folder, own_name
from .tables import stored

END_ID = 1
LENGTH = 2048
ROWS_PER_BATCH = 128
CACHED_WORDS = 1_000_000
LONGEST_CACHED = 48
#: letters before this code point stay single letters when normalised and lower-cased
LATIN_END = "\u0100"


class Encoder:
    """Whole texts to ids; a piece of a text between blanks or line ends is encoded once."""

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
        # tokens that end a run of letters, where the vocabulary marks them
        self.closing = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.end = np.array([end_id], self.dtype).tobytes()

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in out]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Runs of Latin letters, encoded as one text and cut behind the closing tokens."""
        ids = np.array(self.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids, self.dtype)
        ends = (np.flatnonzero(self.closing[ids]) + 1) * self.dtype.itemsize
        if len(ends) != len(runs):
            return self._one_by_one(runs)
        data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return [data[i:j] for i, j in zip(starts, ends.tolist(), strict=True)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces not met before.

        The tokenizer splits letters from all else, so a run of letters with a mark behind it
        is the run's ids and the mark's.
        """
        letters = [w for w in pieces if w.isalpha() and max(w) < LATIN_END]
        out = dict(zip(letters, self._runs(letters), strict=True)) if letters else {}
        others = [w for w in pieces if w not in out]
        marked = [w for w in others if w[-1] in ".," and w[:-1].isalpha() and max(w) < LATIN_END]
        if marked:
            marks = dict(zip(".,", self._one_by_one([".", ","]), strict=True))
            runs = list({w[:-1] for w in marked} - out.keys())
            found = out | (dict(zip(runs, self._runs(runs), strict=True)) if runs else {})
            out |= {w: found[w[:-1]] + marks[w[-1]] for w in marked}
            others = [w for w in others if w not in out]
        if others:
            out |= zip(others, self._one_by_one(others), strict=True)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes of ``dtype``."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {"": b""}
            new = set().union(*split) - {""}
        now = self._new(list(new)) if new else {}
        look = self.known | now if len(now) > CACHED_WORDS else self.known
        if look is self.known:
            look.update(now)
        out = [b"".join(map(look.__getitem__, words)) + self.end for words in split]
        for w in [w for w in now if len(w) > LONGEST_CACHED]:
            look.pop(w)
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, end_id: int) -> Encoder:
    if (vocabulary, end_id) not in _encoders:
        _encoders[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _encoders[vocabulary, end_id]


class _Shard:
    """Writes the two files of one shard as ids come in; holds at most one batch."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int):
        self.fs, path = open_store(folder)
        self.fs.create_dir(path, recursive=True)
        self.names = [own_name(f"{kind}-{part:06d}", ".arrow") for kind in ("sequences", "documents")]
        self.length, self.dtype = length, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.fs.open_output_stream(f"{path}/{n}") for n in self.names]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, self.index), strict=True)]
        self.held, self.size, self.total, self.docs = [], 0, 0, 0

    def add(self, ids: pa.Array, encoded: list[bytes]):
        n = np.array([len(e) // self.dtype.itemsize for e in encoded], np.int64)
        start = self.total + np.cumsum(n) - n
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n)], schema=self.index))
        self.total += int(n.sum())
        self.docs += len(encoded)
        full = self.length * ROWS_PER_BATCH * self.dtype.itemsize
        for e in encoded:
            self.held.append(e)
            self.size += len(e)
            if self.size >= full:
                data = b"".join(self.held)
                whole = len(data) // full * full
                for at in range(0, whole, full):
                    self._write(np.frombuffer(data[at : at + full], self.dtype))
                self.held, self.size = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, valid: int | None = None):
        mask = (np.arange(len(ids)) < (len(ids) if valid is None else valid)).astype(np.uint8)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.writers[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self):
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        for w, o in zip(self.writers, self.out, strict=True):
            w.close()
            o.close()


MANIFEST = "part long, sequences string, documents string, n_tokens long, n_docs long, length int"


def _write_shards(batches, folder, vocabulary, end_id, length):
    enc, shard, part = encoder(vocabulary, end_id), None, TaskContext.get().partitionId()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            if shard is None:
                shard = _Shard(folder, part, enc.dtype, length)
            encoded = enc.encode([t or "" for t in texts.slice(at, 256).to_pylist()])
            shard.add(ids.slice(at, 256), encoded)
    if shard is not None:
        shard.close()
        row = [part, *(f"{folder}/{n}" for n in shard.names), shard.total, shard.docs, length]
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)


def write_tokens(
    docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", end_id: int = END_ID, length: int = LENGTH
) -> DataFrame:
    """Encode whole texts, write the shards, return the manifest with each shard's first position.

    Documents are in ascending id order (null ids first, equal ids by text).  A null text is an
    empty one: its end id alone.  An empty table gives an empty manifest.
    """
    folder = output_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows that share an id, or have none, are dealt out by how their texts begin
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = stored(rows.mapInArrow(lambda it: _write_shards(it, folder, vocabulary, end_id, length), MANIFEST), "manifest")
    # one row a shard: a running total over shards, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Random access to a written shard."""

    def __init__(self, sequences: str, documents: str):
        self.opened = []
        self.ids, self.index = (self._open(uri) for uri in (sequences, documents))
        first = self.ids.get_batch(0) if self.ids.num_record_batches else None
        self.rows = first.num_rows if first is not None else 1
        self.length = self.ids.schema.field("input_ids").type.list_size
        self._at, self._batch = -1, None

    def _open(self, uri):
        store, path = open_store(uri)
        source = pa.memory_map(path) if uri.startswith("file:") else store.open_input_file(path)
        self.opened.append(source)
        return pa.ipc.open_file(source)

    def batch(self, k: int):
        if k != self._at:
            self._at, self._batch = k, self.ids.get_batch(k)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (1 for an id, 0 for padding) of sequence i, both views of the file."""
        k, row = divmod(i, self.rows)
        batch = self.batch(k)
        here = slice(row * self.length, (row + 1) * self.length)
        return tuple(batch.column(c).values.to_numpy()[here] for c in ("input_ids", "mask"))

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the shard on."""
        size, out = self.rows * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            part = self.batch(k).column("input_ids").values.to_numpy()[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self):
        for source in self.opened:
            source.close()


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["sequences"], row["documents"])
            for k in range(shard.index.num_record_batches):
                index = shard.index.get_batch(k)
                start, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                sums = [zlib.crc32(shard.span(s, m).astype("<u4").tobytes()) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                columns = [index.column("doc_id"), pa.array(start + row["first"]), pa.array(n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
            shard.close()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document what the files hold: doc_id, start, n_tokens, ids_crc32."""
    shards = max(1, manifest.count())
    spread = manifest.select("sequences", "documents", "first").repartition(min(shards, 10_000))
    return spread.mapInArrow(_read, READ)
