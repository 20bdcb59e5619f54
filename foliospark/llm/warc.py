"""WARC archives by way of a chunked record table.

``chunk_records`` turns payloads into rows (record, chunk_no, chunk, digest so far): a payload
of any length is a run of small rows, and each row carries the SHA-1 of the payload up to its
end, so the last row of a record has the payload's digest and no step needs a whole record.
``write_archives`` streams those rows into gzip members, one a record; ``read_archives`` reads
archives block by block with a digest of its own and yields what the bytes say.

Records with equal payloads of at least ``least`` bytes are written once: the one with the
largest page_id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_store, output_folder, own_name
from .tables import stored

CHUNK_BYTES = 1 << 18
LEAST_BYTES = 1000
ROWS_A_BATCH = 64

CHUNKS = "record long, page_id long, url string, chunk_no int, chunk binary, digest string, n_bytes long, last boolean"
_CHUNK_TYPE = pa.schema(
    [
        ("record", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("chunk_no", pa.int32()),
        ("chunk", pa.binary()),
        ("digest", pa.string()),
        ("n_bytes", pa.int64()),
        ("last", pa.bool_()),
    ]
)


def _chunked(batches, size):
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        data = batch.column(2).cast(pa.large_binary())
        for i in range(batch.num_rows):
            payload, sha = memoryview(data[i].as_buffer() or b""), hashlib.sha1()
            record, count = part << 40 | count, count + 1
            ids = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            held = []
            for k in range(max(1, -(-len(payload) // size))):
                chunk = payload[k * size : (k + 1) * size]
                sha.update(chunk)
                last = (k + 1) * size >= len(payload)
                held.append((record, *ids, k, bytes(chunk), sha.copy().hexdigest(), min((k + 1) * size, len(payload)), last))
                if len(held) == 16:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_TYPE, strict=True)], schema=_CHUNK_TYPE)


def chunk_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``pages``; written.  A null payload is an empty one: one empty chunk."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return stored(rows.mapInArrow(lambda it: _chunked(it, chunk_bytes), CHUNKS), "chunks")


def record_types(chunks: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(record, payload_bytes, payload_digest, refers_to, of): null refers_to means a response.

    Of equal payloads the largest page_id answers; of rows that share it the smallest record
    number; rows without page_id answer only among themselves.
    """
    last = chunks.filter("last").select("record", "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    known = F.coalesce(F.col("page_id"), F.lit(-(1 << 62)))
    best = last.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(F.struct(known.alias("page"), (-F.col("record")).alias("r"))).alias("best"))
    best = best.select("payload_digest", (-F.col("best.r")).alias("answer"), F.col("best.page").alias("page"))
    out = last.join(best, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & (F.col("answer") != F.col("record"))
    refers = F.when(again, F.when(F.col("page") > -(1 << 62), F.col("page")))
    return out.select("record", "payload_bytes", "payload_digest", F.coalesce(again, F.lit(False)).alias("again"), refers.alias("refers_to"))


def _head(row) -> bytes:
    """The WARC header of a record and, before its payload, the HTTP header."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    page = "" if row["page_id"] is None else row["page_id"]
    fields = [
        ("WARC-Type", "revisit" if row["again"] else "response"),
        ("WARC-Record-ID", f"<urn:record:{row['record']:024x}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((row["url"] or "").split())),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Page-ID", page),
    ]
    if row["again"]:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Page-ID", "" if row["refers_to"] is None else row["refers_to"]),
        ]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (0 if row["again"] else row["payload_bytes"])),
    ]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


MANIFEST = "archive string, n_records long"


def _archived(batches, folder):
    part, out, member, n, name = TaskContext.get().partitionId(), None, None, 0, None
    store = path = None
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                store, path = open_store(folder)
                store.create_dir(path, recursive=True)
                name = own_name(f"records-{part:06d}", ".warc.gz")
                out = store.open_output_stream(f"{path}/{name}")
            if row["chunk_no"] == 0:
                member = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(member.compress(_head(row)))
                n += 1
            if not row["again"]:
                out.write(member.compress(row["chunk"]))
            if row["last"]:
                out.write(member.compress(b"\r\n\r\n"))
                out.write(member.flush())
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["archive", "n_records"])


def write_archives(chunks: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write one archive a task; the manifest of those that count.

    All chunks of a record go to one task in order, dealt by record number, so records of one
    page or payload are spread like any others.
    """
    folder = output_folder(chunks.sparkSession, "warc")
    types = record_types(chunks, least)
    rows = chunks.select("record", "page_id", "url", "chunk_no", "chunk", "last").join(types, "record")
    # a revisit's bytes are not moved on
    rows = rows.withColumn("chunk", F.when(~F.col("again"), F.col("chunk")))
    rows = rows.filter("not again or chunk_no = 0 or last").repartition("record").sortWithinPartitions("record", "chunk_no")
    return stored(rows.mapInArrow(lambda it: _archived(it, folder), MANIFEST), "manifest")


class Reader:
    """Records of an archive, read in blocks; payloads go through ``sink`` piece by piece."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.raw = stream, block, b""
        self.member, self.data = None, b""

    def _more(self) -> bool:
        """Decompress a little more of the current member, or open the next."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.block)
                if not self.raw:
                    return False
            if self.member is None or self.member.eof:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(self.raw, self.block)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if got:
                self.data += got
                return True

    def _head(self) -> bytes | None:
        while b"\r\n\r\n" not in self.data:
            if not self._more():
                return None
        head, _, self.data = self.data.partition(b"\r\n\r\n")
        return head

    def _take(self, n: int, sink) -> None:
        while n > 0:
            if not self.data and not self._more():
                raise ValueError("an archive ends inside a record")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            sink(piece)

    def records(self):
        """Yield (headers, HTTP headers, payload size, SHA-1 of the payload)."""
        while (head := self._head()) is not None:
            fields = _fields(head)
            http_head = self._head()
            http = _fields(http_head)
            sha, size = hashlib.sha1(), int(fields["Content-Length"]) - len(http_head) - 4
            self._take(size, sha.update)
            self._take(4, lambda _: None)
            yield fields, http, size, sha.hexdigest()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _records(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = open_store(uri)
            rows = []
            with store.open_input_stream(path) as stream:
                for fields, http, size, digest in Reader(stream).records():
                    again = fields["WARC-Type"] == "revisit"
                    # a revisit repeats the header of the full response, and names its digest
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, to = fields["WARC-Page-ID"].rstrip(":"), fields.get("WARC-Refers-To-Page-ID", "")
                    rows.append(
                        (
                            int(page) if page else None,
                            int(http["Content-Length"]) if again else size,
                            said if again else digest,
                            fields["WARC-Type"],
                            int(to) if to else None,
                            again or digest == said,
                        )
                    )
                    if len(rows) == 4096:
                        yield _record_batch(rows)
                        rows = []
            if rows:
                yield _record_batch(rows)


def _record_batch(rows):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """What the archives say, one row a record; ``intact`` compares digest and bytes."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(n).mapInArrow(_records, RECORDS)


def archived_pages(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write all pages as WARC records and read them back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, intact), one row per row.
    Null payloads are empty; rows that repeat an id are records of their own; an empty table
    gives no archive; other columns are not looked at.
    """
    return read_archives(write_archives(chunk_records(pages, id_col, url_col, payload_col)))
