"""Records of several generations of a schema read as one table, and JSON objects keyed by document.

A target names each column with its type, its default, and the names that it had before. Files are read with the schema that they have, generation by
generation (one job a folder, not one a file); what a generation lacks gets the default, what it no longer knows goes, what changed its type is cast, and
values that the new type can't hold are null and counted by the caller if wanted.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Field(NamedTuple):
    name: str
    type: str
    default: object = None
    before: tuple[str, ...] = ()


def evolved(records: DataFrame, target: list[Field]) -> DataFrame:
    """Records of whatever generation in the target's columns. A column under a former name counts where the present one is missing or null; null and ''
    count as missing where there is a default."""

    def column(f: Field) -> Column:
        given = [F.col(f"`{n}`") for n in (f.name, *f.before) if n in records.columns]
        value = F.coalesce(*(c.try_cast(f.type) for c in given)) if given else F.lit(None).cast(f.type)
        if f.default is None:
            return value.alias(f.name)
        value = F.when(value.cast("string") == "", None).otherwise(value) if f.type == "string" else value
        return F.coalesce(value, F.lit(f.default).cast(f.type)).alias(f.name)

    return records.select(*(column(f) for f in target))


def read_generations(spark: SparkSession, folders: list[str], target: list[Field], form: str = "json") -> DataFrame:
    """All folders as one table; each folder's files share a schema, which Spark infers."""
    options = {"multiLine": True} if form == "json-objects" else {}
    read = [spark.read.format("json" if form.startswith("json") else form).options(**options).load(f) for f in folders]
    return reduce(DataFrame.unionByName, [evolved(r, target) for r in read])


def keyed_objects(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value (of a struct or map type) of files that hold one JSON object each: a record for each key, notes (keys that begin
    with _) left out. A file is one row until its keys are told apart."""
    files = spark.read.text(path, wholetext=True)
    # the values first as texts: a note needn't have the records' type
    each = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
    return each.filter(~F.startswith("key", F.lit("_"))).select("key", F.from_json("text", value).alias("value"))
