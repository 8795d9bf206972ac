"""Train and validation split, its metadata, and versioned output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import digest, shuffle
from tessera.operators.align import RANGE_ROWS, global_position
from tessera.operators.select import BITS, keyed_hash, smallest
from tessera.scratch import drop_since, made_so_far, written
from tessera.sources.versions import Versions

#: Levels of the digest trees behind the metadata: 65,536 leaves, so one stays small up to some hundred million ids.
DEPTH = 4
#: Up to so many rows the bits of the seeded shuffle are broadcast, some 16 bytes for 64 rows; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 50_000_000


def validation_count(rows: int, ratio: float) -> int:
    """At least 1, at most all but one, half rounded to even."""
    n = max(1, round(rows * ratio))
    return rows - 1 if rows > 1 and n >= rows else n


def seeded_split(rows: DataFrame, ratio: float, seed: int, id_col: str = "id", image_col: str = "image", order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """(training, validation) by the seeded Mersenne Twister shuffle of the rows sorted by image, at any size.

    The shuffle is sequential, but what it draws depends on the number of rows alone: the driver follows it with a bit a
    row (125 MB for a thousand million) and no row. Rows get their position in the order from ranges and look up their bit
    in words of 64; only the ids chosen for validation are written, and both parts are joins with them.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must be above 0 and below 1")
    # distinct hashes have distinct ids; only where some are equal the ids themselves are counted
    count, filled, hashes = rows.agg(F.count("*"), F.count(id_col), F.count_distinct(F.xxhash64(id_col))).first()
    if not count or filled != count or (hashes != count and rows.agg(F.count_distinct(id_col)).first()[0] != count):
        raise ValueError("rows must have unique non-empty ids")
    spark, mark = rows.sparkSession, made_so_far()
    first = validation_count(count, ratio)
    d = rows.select(id_col, F.coalesce(image_col, F.lit("")).alias("__image"), F.col(order).alias("__order"))
    at = global_position(d, "__image", "__order", ranges=max(8, count // RANGE_ROWS + 1)).select(id_col, (F.col("position") - 1).alias("__at"))
    words = first_words(spark, count, first, seed)
    j = at.join(F.broadcast(words) if count <= BROADCAST_ROWS else words, F.shiftright("__at", 6) == F.col("__word"))
    bit = F.expr("shiftright(__bits, cast(__at & 63 as int)) & 1")
    chosen = written(j.filter(bit == 1).select(id_col), "chosen")
    drop_since(mark, chosen)
    clean = rows.drop("source_image")
    return clean.join(chosen, id_col, "left_anti"), clean.join(chosen, id_col, "left_semi")


def first_words(spark: SparkSession, rows: int, first: int, seed: int) -> DataFrame:
    """(__word, __bits): the bits of ``shuffle.first_rows``, 64 rows a word."""
    import numpy as np
    import pandas as pd

    bits = np.frombuffer(shuffle.first_rows(rows, first, seed), "<i8")
    return spark.createDataFrame(pd.DataFrame({"__word": np.arange(len(bits)), "__bits": bits}), "__word long, __bits long")


def hashed_split(rows: DataFrame, ratio: float, seed: int, key: str = "id") -> DataFrame:
    """``rows`` with is_validation by the hash of the key: one pass, any size, the same for a key wherever it occurs."""
    return rows.withColumn("is_validation", keyed_hash(F.col(key), seed) < int(ratio * (1 << BITS)))


def exact_split(rows: DataFrame, ratio: float, seed: int, key: str = "id") -> DataFrame:
    """``rows`` without source_image, with is_validation: exactly ``validation_count`` of them, those of the smallest keyed hashes.

    The same rows under any partitioning and at any size: the driver sees counts and one key. Keys must be unique and not
    empty, as text too; rows without any are an error.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must be above 0 and below 1")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    by_key = rows.groupBy(text.alias("key")).count()
    distinct, count, empty = by_key.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("key") == "")).first()
    if not count or distinct != count or empty:
        raise ValueError("rows must have unique non-empty ids")
    return smallest(rows.drop("source_image"), validation_count(count, ratio), key, seed, "is_validation")


def metadata(training: DataFrame, validation: DataFrame, ratio: float, seed: int, id_col: str = "id") -> dict:
    """Counts of the parts and the roots of their digest trees: a few values, whatever the size."""
    (t_rows, t_hash), (v_rows, v_hash) = (digest.root(digest.tree(df, id_col, DEPTH)) for df in (training, validation))
    return {"ratio": ratio, "seed": seed, "total_count": t_rows + v_rows, "training_count": t_rows, "validation_count": v_rows,
            "training_ids_hash": t_hash, "validation_ids_hash": v_hash}


def verify(recorded: dict, training: DataFrame, validation: DataFrame, id_col: str = "id") -> list[str]:
    """Fields of the recorded metadata that the data contradict."""
    now = metadata(training, validation, recorded["ratio"], recorded["seed"], id_col)
    return [k for k in now if recorded.get(k) != now[k]]


def write_version(spark: SparkSession, root: str, version: str, **tables: DataFrame) -> None:
    """Writes the tables below root/version and makes them current: readers see all of a version or none of it."""
    Versions(spark, root).write(tables, version)


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Versions(spark, root).read(name)
