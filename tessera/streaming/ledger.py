"""Resume with bounded reads: rows whose id is done already are dropped, by a ledger of ids beside the rows.

The ledger keeps the ids of each batch by bucket, and for each bucket a Bloom filter of one bitmap. A batch first asks
the filters: ids that these exclude are new, and no stored id is read for them. What is left, true repeats and a few
others, is compared with the ids of its buckets. Rows, ids, filters and the commit of a batch lie in folders of its
number; what a batch that stopped half-way left is overwritten when it comes again, and a batch that was committed
adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import delete, exists

#: Bits of a bitmap, as the bitmap functions have it, and probes an id.
BITMAP, PROBES = 32_768, 4
#: Buckets: with 4096 ids a bucket the filters let some 0.3 % of the new ids through to the exact check.
BUCKETS = 4096
#: Folders that the ids of a batch are dealt to, so that a check reads the folders of its buckets only.
PARTS = 16
TABLES = {
    "commits": "new long, asked long, batch int", "ids": "id string, bucket int, batch int, part int", "filters": "bucket int, bitmap binary, batch int",
    "merged": "bucket int, bitmap binary, upto int",
}
#: Filters of so many batches are merged into one.
MERGE_EVERY = 20


def has_bit(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a binary bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class Ledger:
    """Rows below ``root``, each id once. One writer at a time, with ascending batch numbers."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.id_col, self.buckets = spark, root.rstrip("/"), id_col, buckets

    def _read(self, what: str) -> DataFrame | None:
        path = f"{self.root}/{what}"
        if not exists(self.spark, path):
            return None
        return (self.spark.read.schema(TABLES[what]) if what in TABLES else self.spark.read).parquet(path)

    def last(self) -> int:
        """Number of the last batch that was committed, -1 before the first."""
        commits = self._read("commits")
        top = commits.agg(F.max("batch")).first()[0] if commits is not None else None
        return -1 if top is None else top

    def rows(self) -> DataFrame | None:
        """The rows of all committed batches; None before the first."""
        rows = self._read("rows")
        return rows if rows is None else rows.filter(F.col("batch") <= self.last()).drop("batch")

    def _bits(self, id_: Column) -> list[Column]:
        """Positions of an id in the bitmap of its bucket."""
        return [F.pmod(F.xxhash64(F.lit(probe), id_), F.lit(BITMAP)) for probe in range(PROBES)]

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        return ids.withColumn("bucket", bucket).withColumn("part", F.col("bucket") % PARTS)

    def _filters(self) -> DataFrame | None:
        """(bucket, bitmap): the merged filters and those of the batches since, one row a bucket."""
        merged, later = self._read("merged"), self._read("filters")
        last, since = self.last(), -1
        parts = []
        if merged is not None:
            merged = merged.filter(F.col("upto") <= last)
            since = merged.agg(F.max("upto")).first()[0]
            since = -1 if since is None else since
            parts.append(merged.filter(F.col("upto") == since).select("bucket", "bitmap"))
        if later is not None:
            parts.append(later.filter((F.col("batch") > since) & (F.col("batch") <= last)).select("bucket", "bitmap"))
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def append(self, batch: DataFrame, number: int) -> dict:
        """Adds the rows of a batch whose id is new, one an id, and commits the batch: {batch, rows, new, asked}, ``asked``
        being the ids that the filters did not exclude. A committed batch comes back with no new rows.

        Null ids are one id. Of rows with one id any is taken.
        """
        if number <= self.last():
            return {"batch": number, "rows": 0, "new": 0, "asked": 0}
        key = F.coalesce(F.col(self.id_col).cast("string"), F.lit(""))
        rows = batch.withColumn("__id", key).dropDuplicates(["__id"])
        ids = self._bucketed(rows.select(F.col("__id").alias("id")))
        done, asked = self._done(ids, number)
        fresh = rows if done is None else rows.join(done.withColumnRenamed("id", "__id"), "__id", "left_anti")
        at = lambda what: f"{self.root}/{what}/batch={number}"
        fresh.drop("__id").write.mode("overwrite").parquet(at("rows"))
        new = ids if done is None else ids.join(done, "id", "left_anti")
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(at("ids"))
        written = self.spark.read.schema(new.schema).parquet(at("ids"))
        probes = written.select("bucket", F.explode(F.array(*self._bits(F.col("id")))).alias("bit"))
        probes.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode("overwrite").parquet(at("filters"))
        counts = {"batch": number, "new": written.count(), "asked": asked}
        self.spark.createDataFrame([(counts["new"], asked)], "new long, asked long").coalesce(1).write.mode("overwrite").parquet(at("commits"))
        delete(self.spark, f"{self.root}/asked/batch={number}")
        if (number + 1) % MERGE_EVERY == 0:
            self.merge()
        return counts | {"rows": counts["new"]}

    def _done(self, ids: DataFrame, number: int) -> tuple[DataFrame | None, int]:
        """(ids that earlier batches have, number of ids that were compared with stored ones)."""
        filters, stored = self._filters(), self._read("ids")
        if filters is None or stored is None:
            return None, 0
        maybe = ids.join(filters, "bucket")  # a bitmap a bucket: AQE broadcasts it while small
        for bit in self._bits(F.col("id")):
            maybe = maybe.filter(has_bit(F.col("bitmap"), bit))
        path = f"{self.root}/asked/batch={number}"
        maybe.select("id", "bucket", "part").write.mode("overwrite").parquet(path)
        maybe = self.spark.read.schema("id string, bucket int, part int").parquet(path)
        parts = [r.part for r in maybe.select("part").distinct().collect()]  # at most PARTS numbers
        old = stored.filter((F.col("batch") <= self.last()) & F.col("part").isin(parts)).select("id", "bucket")
        return maybe.join(old, ["id", "bucket"], "left_semi").select("id"), maybe.count()

    def merge(self) -> None:
        """Merges the filters of the batches so far into one bitmap a bucket, and deletes those that it replaces."""
        filters, last = self._filters(), self.last()
        if filters is None:
            return
        filters.write.mode("overwrite").parquet(f"{self.root}/merged/upto={last}")
        for name, column, keep in (("filters", "batch", None), ("merged", "upto", last)):
            df = self._read(name)
            for r in df.select(column).distinct().collect() if df is not None else ():  # at most MERGE_EVERY numbers and two
                if r[0] <= last and r[0] != keep:
                    delete(self.spark, f"{self.root}/{name}/{column}={r[0]}")

    def size(self) -> DataFrame:
        """One row: committed batches, ids, and buckets with a filter, each of BITMAP / 8 bytes."""
        ids, filters = self._read("ids"), self._filters()
        if ids is None or filters is None:
            return self.spark.createDataFrame([(0, 0, 0)], "batches long, ids long, filters long")
        last = self.last()
        n = ids.filter(F.col("batch") <= last).agg(F.count("*").alias("ids"))
        return n.select(F.lit(last + 1).cast("long").alias("batches"), "ids", F.lit(filters.count()).alias("filters"))
