"""The k smallest rows by a keyed hash, exactly and without a sort: histograms that narrow to the k-th one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a hash, and bits that each histogram tells apart: it has 2**STEP counts, whatever the number of rows.
BITS, STEP = 60, 12
#: Rows around the k-th one that are few enough to be put in order.
FEW = 10_000


def keyed_hash(key: Column, seed: int) -> Column:
    """A number below 2**BITS from a seed and a key, the same wherever the key occurs; a null key hashes as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def kth(rows: DataFrame, k: int) -> tuple[int, object] | None:
    """(hash, key) of the k-th row of (h, key) in the order of hash and key, nulls first; None: there are fewer rows.

    Each pass counts the rows of the range that holds the k-th one by its next bits; counts are summed before they are
    shuffled, and the driver gets at most 2**STEP of them. It stops where at most ``FEW`` rows are left, or where the
    hashes of those left are equal.
    """
    if k < 1:
        raise ValueError("k must be positive")
    low, bits, left = 0, BITS, k
    while bits:
        width = min(STEP, bits)
        bits -= width
        part = rows.filter((F.col("h") >= low) & (F.col("h") < low + (1 << (bits + width))))
        counts = sorted(part.groupBy(F.shiftright(F.col("h") - low, bits).alias("part")).count().collect())
        for nth, n in counts:
            if left <= n:
                low += nth << bits
                break
            left -= n
        else:
            return None
        if n <= FEW:
            break
    few = rows.filter((F.col("h") >= low) & (F.col("h") < low + (1 << bits)))
    if n <= FEW:
        r = few.orderBy("h", "key").limit(left).collect()[-1]
        return r.h, r.key
    # all of them have one hash: equal keys, or a clash; keys are then found by their own order
    by_key = few.groupBy("key").count().orderBy(F.col("key").asc_nulls_first())
    seen = 0
    for r in by_key.toLocalIterator():
        seen += r["count"]
        if seen >= left:
            break
    return low, r.key


def smallest(df: DataFrame, k: int, key: str, seed: int, out: str) -> DataFrame:
    """``df`` with ``out``: whether a row is among the k first by keyed hash, ties by key; rows of one key go together, so
    with repeated keys more than k may be marked. No row moves: the mark is a comparison."""
    h = keyed_hash(F.col(key), seed)
    if k < 1:
        return df.withColumn(out, F.lit(False))
    found = kth(df.select(h.alias("h"), F.col(key).alias("key")), k)
    if found is None:
        return df.withColumn(out, F.lit(True))
    top, last = found
    tie = F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last))
    return df.withColumn(out, (h < top) | ((h == top) & tie))
