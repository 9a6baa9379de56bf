"""Rechecking pending invoices after changes of vendors and orders, reading and writing only what these reach.

Everything is kept in buckets: invoices and results by their vendor, an index of cited orders by the order, vendors and orders by themselves.
A micro-batch of changes names its vendors' and orders' buckets; the index tells in which buckets the invoices lie that cite a changed
order. Only these are read, their reached invoices checked again, and their buckets written under a new version. A manifest, written last, says which
version of each bucket counts: a batch that is run again after a failure writes the same version again, and a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Buckets:
    """A table in n buckets by the hash of a key, each in the version that the manifest names."""

    def __init__(self, spark: SparkSession, path: str, key: str, n: int) -> None:
        self.spark, self.path, self.key, self.n = spark, path, key, n
        self.touched: list[set[int]] = []  # the buckets that were read, call by call

    def bucket(self, key: Column | None = None) -> Column:
        return F.coalesce(F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast("string")), F.lit(self.n)), F.lit(0)).cast("int")

    def of(self, keys: DataFrame, column: str) -> set[int]:
        """The buckets of these keys; n numbers at most reach the driver."""
        return {r[0] for r in keys.select(self.bucket(F.col(column))).distinct().collect()}

    def manifest(self) -> dict[int, int]:
        seen = self.spark.read.schema("bucket int, version int, at int").json(f"{self.path}/manifest")
        last = seen.agg(F.max("at")).first()[0]
        return {r.bucket: r.version for r in seen.filter(F.col("at") == last).collect()}

    def put(self, rows: DataFrame, version: int, buckets: set[int] | None = None) -> None:
        """Replaces all buckets, or these, with rows."""
        kept = {} if buckets is None else self.manifest()
        self.schema = rows.schema
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        now = kept | dict.fromkeys(range(self.n) if buckets is None else buckets, version)
        entries = self.spark.createDataFrame([(b, v, version) for b, v in now.items()], "bucket int, version int, at int")
        entries.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/at={version}")

    def get(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of these: only their folders are listed and read."""
        counts = self.manifest()
        self.touched.append(set(counts) if buckets is None else set(buckets))
        versions: dict[int, list[int]] = {}
        for b, v in counts.items():
            if buckets is None or b in buckets:
                versions.setdefault(v, []).append(b)
        found, stored = None, StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        for v, some in sorted(versions.items()):
            base = f"{self.path}/rows/version={v}"
            rows = self.spark.read.schema(stored).parquet(base).filter(F.col("bucket").isin(some)).drop("bucket")
            found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if found is None else found


def check(invoices: DataFrame, vendors: DataFrame, orders: DataFrame) -> DataFrame:
    """id, vendor, vendor_status, vendor_kind and po_status of invoices (id, vendor, po_number, total) against vendors (vendor, status) and
    orders (po_number, remaining)."""
    known = vendors.select(F.col("vendor").alias("v"), F.coalesce("status", F.lit("approved")).alias("state"))
    listed = orders.select(F.col("po_number").alias("po"), "remaining")
    joined = invoices.join(known, F.col("vendor") == F.col("v"), "left").join(listed, F.col("po_number") == F.col("po"), "left")
    status = F.when(F.col("vendor").isNull(), "skip").when(F.col("v").isNull(), "warn").when(F.col("state") == "rejected", "fail").when(F.col("state") == "approved", "pass").otherwise("warn")
    kind = F.when(F.col("vendor").isNull(), None).when(F.col("v").isNull(), "new").when(F.col("state") == "verified", "awaiting_approval").when(F.col("state") != "approved", F.col("state"))
    missing = F.col("po_number").isNull() | (F.col("po_number") == "")
    order = (
        F.when(missing, "skip").when(F.col("po").isNull(), "warn").when(F.col("total") > F.col("remaining") * 1.02 + 0.02, "fail").when(F.col("total") > F.col("remaining") + 0.02, "warn").otherwise("pass")
    )
    return joined.select("id", "vendor", status.alias("vendor_status"), kind.alias("vendor_kind"), order.alias("po_status"))


class Recheck:
    """The checks of pending invoices, kept up to date under changes (kind: vendor or order, key, seq, status, remaining)."""

    def __init__(self, spark: SparkSession, path: str, n: int = 64) -> None:
        table = lambda name, key: Buckets(spark, f"{path}/{name}", key, n)
        self.invoices, self.results, self.cited = table("invoices", "vendor"), table("results", "vendor"), table("cited", "po_number")
        self.vendors, self.orders = table("vendors", "vendor"), table("orders", "po_number")

    def begin(self, invoices: DataFrame, vendors: DataFrame, orders: DataFrame) -> None:
        """Writes everything and checks all invoices once."""
        pending = invoices.select("id", "vendor", "po_number", "total")
        self.invoices.put(pending, 0)
        self.cited.put(pending.filter("po_number IS NOT NULL").select("po_number", "id", "vendor"), 0)
        self.vendors.put(vendors.select("vendor", "status"), 0)
        self.orders.put(orders.select("po_number", "remaining"), 0)
        self.results.put(self.full(), 0)

    def full(self) -> DataFrame:
        """All invoices checked against the tables as they are now."""
        return check(self.invoices.get(), self.vendors.get(), self.orders.get())

    def _merge(self, table: Buckets, latest: DataFrame, version: int) -> set[int]:
        """Replaces the rows of a table whose keys have changed; returns their buckets."""
        buckets = table.of(latest, table.key)
        if buckets:
            rest = table.get(buckets).join(latest.select(table.key), table.key, "left_anti")
            table.put(rest.unionByName(latest), version, buckets)
        return buckets

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch: for foreachBatch. The last change of a key counts."""
        version = batch + 1
        last = changes.groupBy("kind", "key").agg(F.max_by(F.struct("status", "remaining"), "seq").alias("c"))
        vendor_type, order_type = self.vendors.schema["vendor"].dataType, self.orders.schema["po_number"].dataType
        vendors = last.filter("kind = 'vendor'").select(F.col("key").cast(vendor_type).alias("vendor"), "c.status")
        orders = last.filter("kind = 'order'").select(F.col("key").cast(order_type).alias("po_number"), "c.remaining")
        reached = self.vendors.of(vendors, "vendor")
        self._merge(self.vendors, vendors, version)
        changed = self._merge(self.orders, orders, version)
        citing = self.cited.get(changed).join(orders.select("po_number"), "po_number", "left_semi") if changed else None
        if citing is not None:
            reached |= self.results.of(citing, "vendor")
        if not reached:
            return
        pending = self.invoices.get(reached)
        hit = pending.join(vendors.select("vendor"), "vendor", "left_semi")
        if citing is not None:
            hit = hit.unionByName(pending.join(citing.select("id"), "id", "left_semi")).dropDuplicates(["id"])
        now = check(hit, self.vendors.get(self.vendors.of(hit, "vendor")), self.orders.get(self.orders.of(hit, "po_number")))
        kept = self.results.get(reached).join(now.select("id"), "id", "left_anti")
        self.results.put(kept.unionByName(now), version, reached)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts a query that applies a stream of changes until it has read all that is there."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
