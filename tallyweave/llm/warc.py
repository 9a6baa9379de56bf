"""WARC archives: one gzip member per record, written and read sequentially by Spark tasks.

Writing: payload digests and the grouping of equal payloads are DataFrame operations over digests and ids (the
group's largest page_id by a map-side combined aggregate, joined back only for groups of more than one). Tasks then stream
their records into archives of about ``FILE_BYTES``. Of equal payloads one record is a response, the others
are revisits that keep the HTTP header but no body. Reading: one task walks an archive from front to back,
decompressing incrementally, framing records by Content-Length and checking digests; it holds at most one
record and one chunk. Archives are read as DataFrame rows, so a failed task is simply run again.

Null html: an empty payload. Null url: no target URI. Repeated page_ids: each row is a record; among equal
payloads those that share the largest page_id are all responses. Null page_id: never the response of a group
that has another. Empty table: no archives and no rows. Payloads of fewer than ``min_bytes`` are always
responses. A record that is cut off or whose digest differs is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.store import filesystem, shared_dir, tasks_for, written

FILE_BYTES, CHUNK, LEVEL, SALTS = 64 << 20, 256 << 10, 3, 16
DATE = "2026-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_refers_to(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and, for revisits, refers_to: the largest page_id of equal payloads. Digests and ids are
    shuffled, payloads only if the revisits, written first, are too many for Spark to broadcast."""
    digest = F.unhex(F.sha2("payload", 256))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keys = written(rows.filter(F.length("payload") >= min_bytes).select("page_id", digest.alias("key")), "keys")
    groups = keys.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    # one payload may be that of a third of all pages: its pages are dealt over SALTS tasks
    groups = groups.select("key", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    revisits = salted.join(groups, ["key", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()
    revisits = written(revisits, "revisits").withColumnsRenamed({"page_id": "of", "key": "of_key"})
    joined = rows.withColumn("key", digest).join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select("page_id", "url", "payload", "refers_to")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A response or revisit record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to) to archives; returns (file, size) of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, size = None, "", 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                out.write(member)
                size += len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "size": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "size": [size]})

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string, size long"), "archives")


def members(read, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of concatenated gzip members, each framed by its Content-Length; read(n) gives bytes."""
    data = read(chunk)
    while data:
        z, text, need, seen = zlib.decompressobj(31), bytearray(), -1, 0
        while not z.eof:
            if not data and not (data := read(chunk)):
                raise EOFError("an archive ends within a record")
            text += z.decompress(data, chunk)
            data = z.unconsumed_tail or z.unused_data
            if need < 0:  # the header goes on until an empty line, however long it is; what was searched isn't searched again
                end = text.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(text)
                if end >= 0:
                    need = end + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", text[:end])[1]) + 4
            if 0 <= need < len(text):
                raise ValueError("a record's framing is broken")
        if len(text) != need or text[-4:] != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        yield bytes(text[:-4])
        data = data or read(chunk)


def parse(text: bytes) -> dict:
    """A record's fields; checks both digests."""
    head, _, block = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/") or fields["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives (file, size), with their payloads unless told not to; see RECORDS. An archive is
    read by one task; tasks grow with the bytes."""
    names = [x.split()[0] for x in RECORDS.split(", ")][: None if payloads else -1]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        rows: list[dict] = []
        size = 0

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{file}", compression=None) as f:
                    for text in members(f.read):
                        rows.append(parse(text))
                        size += len(text) if payloads else 100
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
        if rows:
            yield batch_of(rows)

    schema = ", ".join(x for x in RECORDS.split(", ") if x.split()[0] in names)
    n_files, n_bytes = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.select("file").repartition(tasks_for(files.sparkSession, n_files, n_bytes)).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes all pages as archives into a new shared folder; returns the list of archives and the folder."""
    folder = shared_dir(pages.sparkSession, "warc")
    return write_archives(with_refers_to(pages, min_bytes), folder), folder


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    files, folder = archive_pages(pages, min_bytes)
    return read_archives(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
