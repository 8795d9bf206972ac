"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame operations only.

A fingerprint keeps the k smallest 48-bit hashes of a text's distinct five-word shingles. Sketches of parts merge by
union and cut; two sketches estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, table, words_of

#: Hashes kept: the standard error of a resemblance r is sqrt(r * (1 - r) / K), at most 0.045.
K = 128
SHINGLE = 5
BITS, DIGITS = 48, 12
#: Rows to a range of ids, and ranges at most: the split points are what the driver holds.
RANGE_ROWS, RANGES = 512, 1024


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Array of 48-bit hashes of the n-word shingles; fewer words: the whole sequence as one; no words: none."""

    def of(h: Column) -> Column:
        rolled = F.transform(h, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]), 64 - BITS))
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= n, F.slice(rolled, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))).when(F.size(h) > 0, short).otherwise(none)

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of)


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; exact while both have at most k together; two empty ones: 1."""
    common = lambda u: F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1)))
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common(u) / F.greatest(F.size(u), F.lit(1))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; a empty: 1."""
    below = lambda x, u: F.size(F.filter(x, lambda v: v <= F.element_at(u, -1)))
    own = lambda u: F.when(F.size(u) == 0, F.lit(0)).otherwise(below(a, u))
    return let(merge(a, b, k), lambda u: F.when(own(u) == 0, F.lit(1.0)).otherwise(below(F.array_intersect(a, b), u) / F.greatest(own(u), F.lit(1))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    far = F.lit(float(k - 1)) / (F.element_at(a, -1) + 1) * float(1 << BITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(far)


def encode(a: Column) -> Column:
    """A sketch as a string: 12 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def decode(s: Column) -> Column:
    n = (F.length(s) / DIGITS).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(s, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint): one row a row of ``docs``; null text: as empty, an empty fingerprint."""
    return docs.select(F.col(id_col).alias("doc_id"), encode(sketch(shingle_hashes(F.coalesce(F.col(text_col), F.lit(""))), k)).alias("fingerprint"))


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """Rows (doc_id, text, tie, range, guest) and a window in which lead() reaches the next document by id.

    Ids are cut into ranges at approximate quantiles (at most RANGES of them, the only thing the driver gets), each
    into equal parts where the table is large. The first row of a range also goes to the range before as a guest, the
    first of all to the last, so each text is shuffled once and no task sees more than a range. Null ids come first;
    equal ids go by the hash of the text.
    """
    ids = docs.select("doc_id")
    count = ids.count()
    n = max(1, min(RANGES, count // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 10 * RANGES)).first()[0] or []
    cuts = sorted(set(cuts))
    inner = F.lit(cuts[1:-1]) if len(cuts) > 2 else F.array().cast("array<bigint>")
    first = F.coalesce(F.size(F.filter(inner, lambda c: c <= F.col("doc_id"))), F.lit(0))
    parts = max(1, math.ceil(count / (n * RANGE_ROWS)))
    where = first.cast("long")
    if parts > 1 and len(cuts) > 1:
        low, high = F.get(F.lit(cuts), first).cast("double"), F.get(F.lit(cuts), first + 1).cast("double")
        place = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1.0)) * parts)
        where = first * F.lit(parts).cast("long") + F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(parts - 1)), F.lit(0))
    starts = docs.select("doc_id", where.alias("range")).groupBy("range").agg(F.min("doc_id").alias("start"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    # the range before: within each quantile range by a window, between them over their at most RANGES last parts
    starts = starts.withColumn("of", F.floor(F.col("range") / parts))
    starts = starts.withColumn("before", F.lag("range").over(Window.partitionBy("of").orderBy("range")))
    ends = starts.groupBy("of").agg(F.max("range").alias("end"))
    ends = ends.withColumn("end_before", F.coalesce(F.lag("end").over(Window.orderBy("of")), F.max("end").over(Window.partitionBy())))
    starts = starts.join(F.broadcast(ends), "of").select(F.col("range").alias("s_range"), F.when(F.col("nulls") == 0, F.col("start")).alias("start"), F.coalesce("before", "end_before").alias("before"))
    small = n * parts <= 100_000
    rows = docs.withColumn("range", where)
    starts = F.broadcast(starts) if small else starts
    rows = rows.join(starts, (F.col("range") == F.col("s_range")) & F.col("doc_id").eqNullSafe(F.col("start")), "left")
    both = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))
    alone = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.explode(F.when(F.col("before").isNotNull(), both).otherwise(alone)).alias("at"))
    rows = rows.select("doc_id", "text", "tie", "at.range", "at.guest")
    return rows, Window.partitionBy("range").orderBy("guest", "doc_id", "tie")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the beginning of the next document.

    One row a row of ``docs``. Null text: empty. A table of one row is its own next document; repeated rows follow one
    another. Two empty fingerprints are alike (1). An empty table gives no rows; other columns are dropped.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, order = with_next(docs)
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), quarter))
    make = lambda t: sketch(shingle_hashes(t), k)
    rows = rows.select("doc_id", "tie", "range", "guest", n.cast("long").alias("n_chars"), make(F.col("text")).alias("own"), F.when(~F.col("guest"), edited).alias("edited"))
    rows = rows.withColumn("next", F.lead("own").over(order)).filter(~F.col("guest"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", make(F.col("edited")).alias("changed"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encode(F.col("own")).alias("fingerprint"), encode(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
    )


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
