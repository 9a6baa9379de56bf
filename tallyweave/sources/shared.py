"""Folders for tables and streams that jobs write while they run."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own(application: str) -> str:
    """One folder of this machine for an application that runs on it alone."""
    return "file://" + tempfile.mkdtemp(prefix="written_")


def folder(spark: SparkSession, what: str = "written") -> str:
    """A new folder below spark.checkpoint.dir; a local one only where that is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        root = _own(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{what}_{uuid.uuid4().hex}"


def once(rows: DataFrame, what: str) -> DataFrame:
    """Rows written and read back: what looks at them from many sides neither works them out nor plans them again."""
    rows.write.parquet(at := f"{folder(rows.sparkSession, what)}/rows")
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def by_key(rows: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Rows dealt by a key over as many tasks as shuffles have, or least: small as they are, they take much work, so that adaptive
    execution, which goes by bytes, must not put them together."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
