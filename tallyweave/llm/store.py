"""Files and tables that jobs share while they run, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir(application: str) -> str:
    """One folder of this machine for an application that runs on it alone."""
    return "file://" + tempfile.mkdtemp(prefix="shared_")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir, as a URI. Only where the setting is missing and all tasks run
    on this machine (tests) a local folder stands in for it; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        root = _own_dir(context.applicationId)
    return f"{root.rstrip('/')}/{what}_{uuid.uuid4().hex}"


#: Rows of narrow tables that a task writes where their number is known.
FILE_ROWS = 250_000


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. Where the rows
    are known to be at most so many, they go to no more tasks and files than those need (or than run at once)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = shared_dir(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bytes that a task reads of files named in a table.
TASK_BYTES = 64 << 20


def tasks_for(spark: SparkSession, items: int, size: int) -> int:
    """Tasks for a table that names items of size bytes in all: one for each TASK_BYTES, at least as many as run
    at once, at most one an item."""
    return max(1, min(items, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that written() made and nothing will read again, not even a task run anew."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot with more than this share of the rows; there are at most 1 / HOT_SHARE of them.
HOT_SHARE, SALTS = 0.001, 32


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with table, without all rows of a hot key in one task: these are dealt over SALTS tasks, each with
    table's rows of that key. Only hashes of the hot keys pass the driver, at most 1 / HOT_SHARE, and both sides look
    their keys up among them: one job ranks the keys, a second one counts all rows where a key has more than SALTS.
    counts (on, n) may be given where they are known; how is inner, left or left_semi."""
    ranked = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    # one type on both sides: a key hashes alike
    key = F.xxhash64(*(F.col(c).cast(rows.schema[c].dataType) for c in on))
    top = ranked.filter(F.col("n") > SALTS).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).select(key.alias("h"), "n").collect()
    if top:
        total = rows.count() if counts is None else counts.agg(F.sum("n")).first()[0]
        top = [r["h"] for r in top if r["n"] > HOT_SHARE * total]
    if not top:
        return rows.join(table, on, how)
    others = [c for c in rows.columns if c not in on] or on
    left = rows.withColumn("salt", F.when(key.isin(top), F.pmod(F.xxhash64(*others), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(key.isin(top), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("salt", F.explode(salts)), [*on, "salt"], how).drop("salt")
