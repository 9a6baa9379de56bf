"""Media columns: binary payloads in archive directories, read by a Spark data source.

Payloads are kept as 8-bit greyscale PNG images, 64 samples a row (lossless), in archives: members one after
the other, each behind a fixed header, with an index file of (offset, size) beside it. The data source
``media_archives`` lists an archive directory, plans byte-range partitions over the archives' sizes, and each
partition finds its members in the index by binary search, streams them with one ranged read a batch and
yields Arrow batches. A member that can't be read or whose checksum differs is read again on its own by
offset, so one bad read costs one member and not the partition.

Null text: an empty payload (64 zero bytes once padded). Null doc_ids are kept. Repeated rows are stored
again. An empty directory gives no rows. A member that stays broken after ``retries`` reads is an error.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyweave.llm.store import filesystem, shared_dir

WIDTH, LEVEL = 64, 1
FILE_BYTES, RANGE_BYTES, BATCH_BYTES, MAX_RANGES = 128 << 20, 8 << 20, 2 << 20, 50_000
#: Member header: mark, has an id, id, unpadded bytes, media bytes, CRC-32 of the media.
HEADER = "<4s?xxxqqqI4x"
HEADER_BYTES = struct.calcsize(HEADER)
ENTRY = np.dtype([("offset", "<i8"), ("size", "<i8")])
MARK = b"MEMB"
ARCHIVES = "file string, members long, size long"
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A greyscale image with the payload as its samples, WIDTH a row."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with filter 0: none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, rows = 8, b"", 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk of the image does not have its checksum")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, standard deviation and shares of 16 levels of the samples."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) / len(x)
    return f"{len(x) // WIDTH};{x.mean():.6f};{x.std():.6f};" + ",".join(f"{s:.6f}" for s in shares)


def write_archives(docs: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Stores all texts of docs in archives; returns (file, members, size) of those that count, and where that
    table is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, at, index = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            with fs.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(np.array(index, ENTRY).tobytes())
            return pa.RecordBatch.from_pydict({"file": [name], "members": [len(index)], "size": [at]})

        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                if out is None:
                    name, at, index = f"media-{uuid.uuid4().hex}", 0, []
                    out = fs.open_output_stream(f"{path}/{name}.dat", buffer_size=1 << 20)
                data, key = (text.as_py() or "").encode(), doc_id.as_py()
                media = encode_png(padded(data))
                out.write(struct.pack(HEADER, MARK, key is not None, key or 0, len(data), len(media), zlib.crc32(media)))
                out.write(media)
                index.append((at, HEADER_BYTES + len(media)))
                at += HEADER_BYTES + len(media)
                if at >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    manifest = shared_dir(docs.sparkSession, "archives")
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ARCHIVES).write.parquet(manifest)
    return docs.sparkSession.read.schema(ARCHIVES).parquet(manifest), manifest


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int
    members: int | None = None  # of the whole archive, as the manifest has it

    def __post_init__(self) -> None:
        self.value = (self.file, self.start, self.end)


class MediaReader(DataSourceReader):
    """Members whose header begins in a partition's byte range belong to it."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.manifest = options.get("manifest")

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the archives: those of the manifest if there is one, else all of the folder. Ranges widen so
        that there are not many more than MAX_RANGES."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector

        members: dict[str, int] = {}
        if self.manifest is None:
            fs, path = filesystem(self.folder)
            found = fs.get_file_info(FileSelector(path, allow_not_found=True))
            sizes = sorted((x.base_name[:-4], x.size) for x in found if x.base_name.endswith(".dat"))
        else:
            fs, path = filesystem(self.manifest)
            parts = [x.path for x in fs.get_file_info(FileSelector(path)) if x.base_name.endswith(".parquet")]
            # a part that can't be read is an error: its archives would be lost
            rows = [r for p in sorted(parts) for r in ds.dataset(p, filesystem=fs, format="parquet").to_table(columns=["file", "size", "members"]).to_pylist()]
            sizes = sorted((r["file"], r["size"]) for r in rows)
            members = {r["file"]: r["members"] for r in rows}
        step = max(self.range_bytes, -(-sum(size for _, size in sizes) // MAX_RANGES))
        return [ByteRange(n, a, min(a + step, size), members.get(n)) for n, size in sizes for a in range(0, size, step)] or [ByteRange("", 0, 0)]

    def _index(self, fs, path: str, part: ByteRange) -> np.ndarray:
        """Entries of the members that begin in the range."""
        with fs.open_input_file(f"{path}/{part.file}.idx") as f:
            n = f.size() // ENTRY.itemsize
            if f.size() != ENTRY.itemsize * (n if part.members is None else part.members):
                raise ValueError(f"the index of {part.file} is damaged or lacks members")

            def first(at: int) -> int:  # the first entry at this offset or after it
                low, high = 0, n
                while low < high:
                    mid = (low + high) // 2
                    if np.frombuffer(f.read_at(ENTRY.itemsize, mid * ENTRY.itemsize), ENTRY)[0]["offset"] < at:
                        low = mid + 1
                    else:
                        high = mid
                return low

            a, b = first(part.start), first(part.end)
            return np.frombuffer(f.read_at((b - a) * ENTRY.itemsize, a * ENTRY.itemsize), ENTRY)

    @staticmethod
    def member(data: bytes) -> tuple:
        mark, has_id, doc_id, n_bytes, size, crc = struct.unpack_from(HEADER, data)
        media = data[HEADER_BYTES :]
        if mark != MARK or len(media) != size or zlib.crc32(media) != crc:
            raise ValueError("a member does not have its checksum")
        return doc_id if has_id else None, n_bytes, media

    def again(self, fs, path: str, part: ByteRange, offset: int, size: int) -> tuple:
        """Reads one member by its offset, some times if need be."""
        for k in range(self.retries):
            try:
                with fs.open_input_file(f"{path}/{part.file}.dat") as f:
                    return self.member(f.read_at(size, offset))
            except (OSError, ValueError, struct.error):
                if k == self.retries - 1:
                    raise
                time.sleep(0.1 * 2**k)
        raise ValueError("no retries are allowed")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        fs, path = filesystem(self.folder)
        entries = self._index(fs, path, partition)
        with fs.open_input_file(f"{path}/{partition.file}.dat") as f:
            a = 0
            while a < len(entries):
                ends = entries["offset"][a:] + entries["size"][a:] - entries["offset"][a]
                b = a + max(1, int(np.searchsorted(ends, BATCH_BYTES, side="right")))
                base = int(entries["offset"][a])
                try:
                    data = f.read_at(int(ends[b - a - 1]), base)
                except OSError:
                    data = b""
                rows = []
                for offset, size in entries[a:b].tolist():
                    try:
                        rows.append(self.member(data[offset - base : offset - base + size]))
                    except (ValueError, struct.error):
                        rows.append(self.again(fs, path, partition, offset, size))
                ids, lengths, media = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                a = b


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): doc_id, n_bytes, media. Options: rangeBytes, retries, manifest (a
    Parquet table of file and size: other archives in the folder do not count)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """The members of the archives of a folder that the manifest of write_archives names."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("manifest", manifest).load(folder)


def with_features(media: DataFrame) -> DataFrame:
    """Decodes each image and computes the feature of its samples; digests follow in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [decode_png(m) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array((hashlib.sha256(p).hexdigest() for p in payloads), pa.string()),
                    pa.array((zlib.crc32(p[-64:]) for p in payloads), pa.int64()),
                    pa.array((len(m) for m in b.column(2).to_pylist()), pa.int64()),
                    pa.array((hashlib.sha256(m).hexdigest() for m in b.column(2).to_pylist()), pa.string()),
                    pa.array(map(feature, payloads), pa.string()),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores all texts as images in archives, reads them back and computes their features."""
    folder = shared_dir(docs.sparkSession, "media")
    _, manifest = write_archives(docs, folder)
    return with_features(read_archives(docs.sparkSession, folder, manifest))
