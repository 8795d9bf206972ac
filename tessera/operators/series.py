"""Operators over ordered series, one a key, whose rows are spread over ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written


def _fold(falls: Column, steps: Column, patience: int, min_delta: float) -> Column:
    """struct(best, bad, stopped_at) from the strict running minima (n, v) of a series of that many steps."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("stopped_at"))

    def add(a: Column, x: Column) -> Column:
        better = a["best"].isNull() | (x["v"] < a["best"] - min_delta)
        late = x["n"] > a["since"] + patience
        return (
            F.when(a["stopped_at"].isNotNull() | ~better, a)
            .when(late, F.struct(a["best"].alias("best"), a["since"].alias("since"), (a["since"] + patience).alias("stopped_at")))
            .otherwise(F.struct(x["v"].alias("best"), x["n"].alias("since"), a["stopped_at"].alias("stopped_at")))
        )

    def end(a: Column) -> Column:
        last = a["since"] + patience
        stopped = F.coalesce(a["stopped_at"], F.when(steps >= last, last))
        return F.struct(a["best"].alias("best"), F.coalesce(F.least(steps, stopped) - a["since"], F.lit(0)).cast("int").alias("bad"), stopped.alias("stopped_at"))

    return F.aggregate(falls, start, add, end)


def early_stops(df: DataFrame, key: str, order: Sequence[str], value: str, patience: int, min_delta: float = 0.0, ranges: int | None = None) -> DataFrame:
    """(key, best, bad, stopped_at): where each series of losses runs out of patience, as ``logits.early_stop`` folds it.

    A step improves if it lies below the best one by more than ``min_delta``, so an improvement is a strict running
    minimum, whatever ``min_delta``: the best lies at most that much above the minimum. Rows are dealt to sampled ranges of
    (key, order), a long series to many; each range learns the steps and the minimum before it from one row a key and
    range, keeps its strict running minima, and only these (about ln n of n values in random order) are folded by key.
    A series that falls at every step keeps all its rows; the stream of the same name, whose state is four numbers,
    suits that better. Null values are steps that do not improve, and do not count before the first value. A null key
    is a series; equal rows keep any order; an empty table gives no rows.
    """
    if patience < 1 or min_delta < 0:
        raise ValueError("patience must be at least 1 and min_delta at least 0")
    spark = df.sparkSession
    ranges = ranges or max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [f"__o{i}" for i in range(len(order))]
    d = df.select(F.col(key).alias("__key"), *[F.col(c).alias(b) for c, b in zip(order, by)], F.col(value).cast("double").alias("__v"))
    d = written(d.repartitionByRange(ranges, "__key", *by, "__v").withColumn("__range", F.spark_partition_id()), "series")
    part = d.groupBy("__key", "__range").agg(F.count("*").alias("__steps"), F.min("__v").alias("__min"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        F.col("__key").alias("__pkey"), F.col("__range").alias("__prange"), "__steps",
        F.coalesce(F.sum("__steps").over(before), F.lit(0)).alias("__before"), F.min("__min").over(before).alias("__low"),
    )
    part = written(part, "series-ranges")
    own = Window.partitionBy("__key", "__range").orderBy(*by, "__v")
    r = d.withColumns({"__n": F.row_number().over(own), "__own": F.min("__v").over(own.rowsBetween(Window.unboundedPreceding, -1))})
    r = r.filter(F.col("__v").isNotNull() & (F.col("__own").isNull() | (F.col("__v") < F.col("__own"))))
    j = r.join(part, F.col("__key").eqNullSafe(F.col("__pkey")) & (F.col("__range") == F.col("__prange")))
    j = j.filter(F.col("__low").isNull() | (F.col("__v") < F.col("__low")))
    falls = j.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct((F.col("__before") + F.col("__n")).alias("n"), F.col("__v").alias("v")))).alias("__falls"))
    steps = part.groupBy(F.col("__pkey").alias("__skey")).agg(F.sum("__steps").alias("__all"))
    none = F.array().cast("array<struct<n:bigint,v:double>>")
    out = steps.join(falls, F.col("__skey").eqNullSafe(F.col("__key")), "left").withColumn("__s", _fold(F.coalesce("__falls", none), F.col("__all"), patience, min_delta))
    return out.select(F.col("__skey").alias(key), "__s.best", "__s.bad", "__s.stopped_at")
