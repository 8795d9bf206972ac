"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a word budget. Whole epochs of the source come first; the rest of the budget goes to the documents
with the smallest exponential keys -ln(u) / quality, u drawn from a hash of the document, up to the budget.

The order within a source is never sorted as a whole. Keys fall into monotone buckets; sums by (source, bucket), which
combine map-side, tell the one bucket of each source where the budget runs out, and only that bucket's keys are sorted,
to find the cut point. A row then knows from its own key what the mix takes of it, so no text is shuffled, and a source
that holds a third of all rows is spread over all tasks. Only rows equal to a cut point that repeats are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop, n_words, table, written

#: Key buckets a source is cut into at least, and rows to a bucket on average where there are more.
BUCKETS, BUCKET_ROWS = 4096, 100_000
#: Up to so many sources (one narrow row each) the plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Copies of a row at the cut that one task numbers.
TIED = 1_000_000
#: Characters that are marks rather than text.
MARKS = r"[#*$%&|<>{}\[\]\\^~=_]"
LEAST_QUALITY = 0.05


def quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: lower the larger the share of marks among the characters, and where words are on
    average shorter than 3 or longer than 12 characters; no language between those is preferred."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text) - size, F.lit(1)).cast("double")  # a blank for each word
    marks = F.regexp_count(text, F.lit(MARKS)) / chars
    per_word = chars / F.greatest(size, F.lit(1)).cast("double")
    return F.greatest(F.exp(-20.0 * marks) * F.least(F.lit(1.0), per_word / 3.0, 12.0 / per_word), F.lit(LEAST_QUALITY))


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number inside (0, 1) that depends on the values alone."""
    top = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return (top.cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) to the same with target: budgets by weight, capped, the excess reshared until none is above.

    Resharing by weight ends at target = least(cap, level * weight). With sources in the order of cap / weight, those
    before some place are capped and the level follows from the rest; windows over one row per source find that place.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(kinds, ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    )
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    s = s.withColumn("place", F.row_number().over(fill))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    s = s.withColumn("first_free", F.min(free).over(everything))
    target = F.when(F.col("place") >= F.col("first_free.place"), F.col("first_free.level") * F.col("weight")).otherwise(F.col("cap"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def measured(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", weight_col: str | None = None) -> DataFrame:
    """``docs`` with mix = struct(id, size, key); a column named ``mix`` is replaced. The weight is that of ``weight_col``,
    null or not above 0 counting as the least, or the quality of the text."""
    text = F.col(text_col)
    size = n_words(text)
    weight = quality(text, size) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    key = -F.ln(uniform(F.col(id_col), F.coalesce(text, F.lit("")), seed=seed)) / F.greatest(weight, F.lit(LEAST_QUALITY if weight_col is None else 1e-9))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], F.struct(F.col(id_col).alias("id"), size.alias("size"), key.alias("key")).alias("mix"))


def plan(points: DataFrame, weights: Sequence[int], share: float, most: float, buckets: int) -> DataFrame:
    """One row a source of ``points`` (source, id, size, key): its goal, as a struct.

    Of ``part``, the words beyond whole epochs, the rows before ``point`` in the order of (key, id, size) give all
    theirs; those equal to it, ``ties`` of them, share the ``left`` ones.
    """
    # key / (1 + key) spreads exponential keys of any weight evenly enough over [0, 1)
    bucket = F.least(F.floor(F.col("key") / (1.0 + F.col("key")) * buckets), F.lit(buckets - 1)).cast("long")
    points = points.withColumn("bucket", bucket)
    sums = written(points.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    words = F.floor(F.col("target") + 0.5).cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("part", words - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    b = sums.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "b_source")
    goal = (
        goal.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("upto") >= F.col("part")) & (F.col("part") > 0), "left")
        .groupBy("source", "source_size", "target", "epochs", "part")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    )
    goal = written(goal, "mix-cuts")
    cuts = goal.filter("cut is not null").select(F.col("source").alias("c_source"), "cut", (F.col("part") - F.col("cut.before")).alias("need"))
    small = goal.count() <= BROADCAST_SOURCES
    near = points.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("cut.bucket")))
    # equal rows count as one here, so a repeated row is one
    near = near.groupBy("source", "need", "key", "id", "size").agg(F.count("*").alias("ties"))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("left", F.col("need") - F.coalesce(F.sum(F.col("ties") * F.col("size")).over(order), F.lit(0)))
    at = near.filter((F.col("left") > 0) & (F.col("left") <= F.col("ties") * F.col("size")))
    at = at.groupBy(F.col("source").alias("p_source")).agg(F.min(F.struct(F.struct("key", "id", "size").alias("point"), "left", "ties")).alias("at"))
    out = goal.join(at, F.col("source").eqNullSafe(F.col("p_source")), "left")
    out = written(out.select(F.struct("source", "source_size", "target", "epochs", "part", "at.point", "at.left", "at.ties").alias("goal")), "mix-goal")
    drop(sums, goal)
    return out


def mixed(rows: DataFrame, points: DataFrame, weights: Sequence[int], share: float, most: float, source_col: str, buckets: int | None = None) -> DataFrame:
    """Rows of ``measured`` with mix = struct(size, source_size, target, taken), by the plan over ``points``."""
    buckets = buckets or max(BUCKETS, points.count() // BUCKET_ROWS)
    goal = plan(points, weights, share, most, buckets)
    n_sources, most_ties = goal.agg(F.count("*"), F.max("goal.ties")).first()
    names = [F.col(f"`{c}`") for c in rows.columns if c != "mix"]
    out = rows.select(F.struct(*names).alias("row"), F.col(f"`{source_col}`").alias("of"), F.struct("mix.key", "mix.id", "mix.size").alias("own"))
    out = out.join(F.broadcast(goal) if n_sources <= BROADCAST_SOURCES else goal, F.col("of").eqNullSafe(F.col("goal.source")))
    size, here, left = F.col("own.size"), F.col("own") == F.col("goal.point"), F.col("goal.left")

    def done(df: DataFrame, extra: Column) -> DataFrame:
        taken = F.col("goal.epochs") * size + F.coalesce(extra, F.lit(0))
        mix = F.struct(size.alias("size"), F.col("goal.source_size").alias("source_size"), F.col("goal.target").alias("target"), taken.cast("long").alias("taken"))
        return df.select("row.*", mix.alias("mix"))

    before = F.when(F.col("own") < F.col("goal.point"), size)
    if (most_ties or 0) < 2:
        return done(out, F.when(here, left).otherwise(before))
    tied = F.coalesce(here, F.lit(False)) & (F.col("goal.ties") > 1)
    plain = done(out.filter(~tied), F.when(here, left).otherwise(before))
    parts = F.ceil(F.col("goal.ties") / TIED)
    some = out.filter(tied).withColumn("salt", F.pmod(F.monotonically_increasing_id(), parts))
    mine = F.floor(left * (F.col("salt") + 1) / parts) - F.floor(left * F.col("salt") / parts)
    nth = F.row_number().over(Window.partitionBy("of", "salt").orderBy(F.xxhash64(F.to_json("row"))))
    some = some.withColumn("rest", mine - (nth - 1) * size)
    return plain.unionByName(done(some, F.least(F.greatest(F.col("rest"), F.lit(0)), size)))


def points_of(rows: DataFrame, source_col: str) -> DataFrame:
    return rows.select(F.col(f"`{source_col}`").alias("source"), "mix.id", "mix.size", "mix.key")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Rows of ``docs`` with mix = struct(size, source_size, target, taken): the words of each row that the mix takes.

    Weights go round the sources in code-point order, null last. Null text: size 0, nothing taken. Null source: a
    source of its own. Repeated rows are separate documents with equal keys. Ties in the key: by id, then size; rows
    equal in all three, by a hash of the row. The document at the cut gives the words that are still missing, so the
    taken words of a source sum to its target, rounded. Of a row that repeats more than ``TIED`` times at the cut,
    tasks take equal shares. An empty table gives no rows. Other columns stay; a column named ``mix`` is replaced.
    ``weight_col`` names a column of quality weights; without it they follow from the texts.
    """
    rows = measured(docs, seed, id_col, text_col, weight_col)
    points = written(points_of(rows, source_col), "mix-points")
    out = mixed(rows, points, weights, share, most, source_col, buckets)
    drop(points)
    return out


def copies(df: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as its words are taken, the one at the cut once more if at least half of it is."""
    names = [c for c in df.columns if c != "mix"]
    times = F.when(F.col("mix.size") > 0, F.floor(F.col("mix.taken") / F.col("mix.size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return df.select(*names, F.explode(F.array_repeat(F.lit(0), times)).alias("mix")).drop("mix")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of documents; texts are measured once, as the result holds none."""
    rows = written(measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix"), "mix-rows")
    return mixed(rows, points_of(rows, "source"), (3, 1, 2), 1.5, 2.0, "source").select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
