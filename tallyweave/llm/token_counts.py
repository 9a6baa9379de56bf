"""Token counts from flat, unindexed token files: a vectorised scan for end-of-document ids.

A token file is nothing but little-endian unsigned ids, each document followed by the separator id. Files
are cut into blocks of ``block_bytes`` that tasks read and search independently (numpy), whatever the file
sizes are. What a block cannot know, where its first document began and how many came before, follows from
an exclusive prefix scan over one small summary row a block; joined back, it stitches documents that cross
block boundaries, however many blocks they span.

Defined results: two adjacent separators enclose a document of 0 tokens; ids after the last separator of a
file are a last document with closed = false; an empty file has no documents; a file whose size is no
multiple of the id size is an error. Writing: null text counts as empty, repeated rows are written again,
and a separator id can't come from a text (names of special tokens are ordinary text).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.chunks import byte_bpe
from tallyweave.llm.store import filesystem, shared_dir, tasks_for, written

BLOCK_BYTES, FILE_BYTES = 8 << 20, 256 << 20


def write_token_files(docs: DataFrame, folder: str, ranks: str, pattern: str, separator: int, dtype: str = "<u2", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all texts to token files in folder; returns the manifest (file, ordinal, doc_id), written too.

    A task that is run again writes files of new names; the manifest names only those of the run that counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        bpe, end, most = byte_bpe(ranks, pattern), np.array([separator], dtype).tobytes(), np.iinfo(dtype).max
        out, name, size, ordinal = None, "", 0, 0
        for batch in batches:
            names, ordinals = [], []
            for text in batch.column(1):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size, ordinal = f"tokens-{uuid.uuid4().hex}.bin", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                ids = np.frombuffer(bpe.encode(text.as_py()), "<u4")
                if len(ids) and int(ids.max()) > most:
                    raise OverflowError(f"id {ids.max()} does not fit {dtype}")
                tokens = ids.astype(dtype).tobytes() + end
                out.write(tokens)
                names.append(name)
                ordinals.append(ordinal)
                size, ordinal = size + len(tokens), ordinal + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(picked.mapInArrow(run, "file string, ordinal long, doc_id long"), "manifest")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file (its name) and size of all token files of a folder; their content isn't read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def document_tokens(files: DataFrame, folder: str, separator: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens and closed of every document in the files (file, size)."""
    item = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % item

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] % item:
                    raise ValueError(f"{row['file']}: {row['size']} bytes are no whole ids")
                first, size = row["block"] * block_bytes, row["size"]
                with fs.open_input_file(f"{path}/{row['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - first), first), dtype)
                ends = np.flatnonzero(ids == separator) + first // item
                closed = True
                if first + len(ids) * item == size and ids[-1] != separator:
                    ends, closed = np.append(ends, size // item), False
                yield pa.RecordBatch.from_pydict(
                    {"file": [row["file"]], "block": [row["block"]], "closed": [closed], "ends": pa.array([ends], pa.list_(pa.int64()))},
                    schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("closed", pa.bool_()), ("ends", pa.list_(pa.int64()))]),
                )

    blocks = files.filter("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_bytes})")).alias("block"))
    n_blocks, n_bytes = files.filter("size > 0").agg(F.coalesce(F.sum(F.expr(f"(size - 1) div {block_bytes} + 1")), F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # the listing is tiny, what it names is not: a count of tasks by bytes, which adaptive execution leaves alone
    found = written(blocks.repartition(tasks_for(files.sparkSession, n_blocks, n_bytes)).mapInArrow(scan, "file string, block long, closed boolean, ends array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last_end"))
    carried = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
    )
    each = found.filter(F.size("ends") > 0).join(carried, ["file", "block"]).withColumn("starts", F.expr("concat(array(carry + 1), transform(slice(ends, 1, size(ends) - 1), e -> e + 1))"))
    rows = each.select("file", "base", "closed", F.size("ends").alias("n"), F.posexplode(F.arrays_zip("starts", "ends")).alias("pos", "doc"))
    return rows.select(
        "file",
        (F.col("base") + F.col("pos")).alias("ordinal"),
        F.col("doc.starts").alias("start"),
        (F.col("doc.ends") - F.col("doc.starts")).alias("n_tokens"),
        (F.col("closed") | (F.col("pos") < F.col("n") - 1)).alias("closed"),
    )


def count_documents(docs: DataFrame, ranks: str, pattern: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """doc_id and n_tokens of each document, by writing the texts as token files and scanning these."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    manifest = write_token_files(docs, folder, ranks, pattern, separator, dtype)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    files = token_files(spark, folder).join(manifest.select("file").distinct(), "file", "left_semi")
    return manifest.join(document_tokens(files, folder, separator, dtype), ["file", "ordinal"]).select("doc_id", "n_tokens")
