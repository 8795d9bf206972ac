"""Early stopping over a stream: a row of state a key, folded on by each batch, however many rows a key has in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import series
from tessera.scratch import exists

STATE = "key string, best double, bad int, steps long, stopped_at long"
#: Phase of the rows of a batch; what stands for the state comes before them.
ROWS = 2**31 - 1


class Stopper:
    """States below ``root``, a folder a batch. One writer at a time, with ascending batch numbers.

    The state of a key enters a batch as rows: its best loss, then one row without a loss for each step since. So the
    batch operator does the work, over as many tasks as the rows need, and the state stays as small as the patience.
    Rows of a batch go in ``order`` and behind those of earlier batches. A batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: Sequence[str], value: str, patience: int, min_delta: float = 0.0):
        self.spark, self.root, self.key, self.order, self.value = spark, root.rstrip("/"), key, list(order), value
        self.patience, self.min_delta = patience, min_delta

    def last(self) -> int:
        path = f"{self.root}/commits"
        if not exists(self.spark, path):
            return -1
        top = self.spark.read.schema("keys long, batch int").parquet(path).agg(F.max("batch")).first()[0]
        return -1 if top is None else top

    def states(self) -> DataFrame:
        """(key, best, bad, steps, stopped_at) of every key so far; steps end where patience ran out."""
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/states/batch={last}")

    def append(self, batch: DataFrame, number: int) -> None:
        if number <= self.last():
            return
        old = self.states()
        order = [f"__o{i}" for i in range(len(self.order))]
        rows = batch.select(F.col(self.key).cast("string").alias("key"), F.lit(ROWS).alias("__phase"), *[F.col(c).alias(o) for c, o in zip(self.order, order)], F.col(self.value).cast("double").alias("value"))
        same = lambda a, b: a["key"].eqNullSafe(b["key"])
        ended = old.filter("stopped_at is not null")
        rows = rows.join(ended, same(rows, ended), "left_anti")
        counts = rows.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("more"))
        live = old.filter("stopped_at is null").join(counts, F.col("key").eqNullSafe(F.col("of"))).drop("of")
        kinds = dict(rows.dtypes)
        before = live.filter("best is not null").select("key", F.explode(F.sequence(F.lit(0), "bad")).alias("__phase"), *[F.lit(None).cast(kinds[o]).alias(o) for o in order], "best")
        before = before.select("key", "__phase", *order, F.when(F.col("__phase") == 0, F.col("best")).alias("value"))
        folded = series.early_stops(rows.unionByName(before), "key", ["__phase", *order], "value", self.patience, self.min_delta)
        folded = folded.select("key", "best", "bad", F.col("stopped_at").alias("stopped"))
        was = old.select(F.col("key").alias("of"), F.when(F.col("best").isNull(), F.col("steps")).otherwise(F.col("steps") - F.col("bad") - 1).alias("start"), "steps")
        new = folded.join(was, F.col("key").eqNullSafe(F.col("of")), "left").drop("of").join(counts, F.col("key").eqNullSafe(F.col("of"))).drop("of")
        at = F.col("stopped") + F.coalesce("start", F.lit(0))
        new = new.select("key", "best", "bad", F.coalesce(at, F.coalesce("steps", F.lit(0)) + F.col("more")).alias("steps"), at.alias("stopped_at"))
        kept = old.join(new, same(old, new), "left_anti")
        new.unionByName(kept).write.mode("overwrite").parquet(f"{self.root}/states/batch={number}")
        done = self.spark.read.schema(STATE).parquet(f"{self.root}/states/batch={number}").count()
        self.spark.createDataFrame([(done,)], "keys long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={number}")
