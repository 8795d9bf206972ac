"""Keyed alignment of row sets: deduplication, outer and inner alignment, set differences, merges, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.scratch import written

ORD = "_ord"


def row_key(df: DataFrame) -> DataFrame:
    """Adds key_kind and key: the trimmed id, or the normalised image path where the id is empty."""
    own = F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    return df.withColumn("key_kind", F.when(own != "", "id").otherwise("image")).withColumn("key", F.when(own != "", own).otherwise(T.image_path(F.col("image"))))


def dedup(df: DataFrame, keys: Sequence[str], keep: str = "first", order: str = ORD) -> DataFrame:
    """One row a key, the first or last by ``order``, with copies: the rows of the key.

    min_by and max_by combine map-side, so a hot key is one row a task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    rows = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__row"), F.count("*").alias("copies"))
    return rows.select(*keys, "__row.*", "copies")


def full_outer(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Predictions and references by row key, the first row of a key on either side; structs pred and ref, null where missing."""

    def side(df: DataFrame, name: str) -> DataFrame:
        d = dedup(row_key(df), ["key_kind", "key"])
        return d.select("key_kind", "key", F.struct(*[c for c in d.columns if c not in ("key_kind", "key")]).alias(name))

    return side(pred, "pred").join(side(ref, "ref"), ["key_kind", "key"], "full_outer")


def aligned_elements(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``full_outer`` of the samples that element rows form: ``rows`` has ``key``, ``order``, and pred and ref, an element
    of either side or null.

    Rows are grouped once for both sides, where they are dealt by ``key`` already without another shuffle. A sample without
    an element of a side is missing there, and one that has none at all is missing on both. Keys must differ as row keys, and not be empty.
    """
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "pred", "ref"))).alias("__es"))
    d = g.select(F.col(key).cast("string").alias("id"), F.lit("").alias("image"), "__es")

    def side(name: str) -> Column:
        own = F.transform(F.filter("__es", lambda e: e[name].isNotNull()), lambda e: e[name])
        return T.let(own, lambda es: F.when(F.size(es) > 0, F.struct(F.col("id").alias("id"), es.alias("elements"), F.lit(1).cast("long").alias("copies")))).alias(name)

    return row_key(d).select("key_kind", "key", side("pred"), side("ref"))


def ordered_labels(elements: Column) -> Column:
    """Array of struct(key, label): distinct labels in order, by label key, the first label of a key kept."""
    named = F.filter(F.transform(elements, lambda e: F.trim(e["text"])), lambda t: t.isNotNull() & (t != ""))
    both = F.transform(named, lambda t: F.struct(T.label_key(t).alias("key"), t.alias("label")))

    def first(a: Column) -> Column:
        keys = F.transform(a, lambda x: x["key"])
        return T.let(keys, lambda k: F.filter(a, lambda x, i: F.array_position(k, x["key"]) == i + 1))

    return T.let(F.coalesce(both, F.array().cast("array<struct<key:string,label:string>>")), first)


def labels_except(a: Column, b: Column) -> Column:
    """Labels of a whose key b lacks, in order."""
    keys = F.transform(b, lambda x: x["key"])
    return T.let(keys, lambda k: F.transform(F.filter(a, lambda x: ~F.array_contains(k, x["key"])), lambda x: x["label"]))


def labels_shared(a: Column, b: Column) -> Column:
    keys = F.transform(b, lambda x: x["key"])
    return T.let(keys, lambda k: F.transform(F.filter(a, lambda x: F.array_contains(k, x["key"])), lambda x: x["label"]))


def unique_elements(teacher: DataFrame, student: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Shared and one-sided labels of the rows that both sides have by (id, image); the last row of a key counts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.trim(F.coalesce(F.col("id"), F.lit(""))).alias("id"), F.trim(F.coalesce(F.col("image"), F.lit(""))).alias("image"), "task", "elements", ORD)
        d = dedup(d, ["id", "image"], "last")
        return d.select("id", "image", F.struct("task", ordered_labels(F.col("elements")).alias("labels")).alias(name))

    j = side(teacher, "t").join(side(student, "s"), ["id", "image"])
    t, s = F.col("t.labels"), F.col("s.labels")
    out = j.select(
        "id", "image", F.col("t.task").alias("task"), F.size(t).alias("teacher_element_count"), F.size(s).alias("student_element_count"),
        labels_shared(t, s).alias("shared_elements"), labels_except(t, s).alias("teacher_unique_elements"), labels_except(s, t).alias("student_unique_elements"),
    )
    for name in ("shared", "teacher_unique", "student_unique"):
        out = out.withColumn(f"{name}_count", F.size(f"{name}_elements"))
    return out if keep_empty else out.filter("teacher_unique_count > 0 or student_unique_count > 0")


def n_way_unique(sources: Sequence[DataFrame], keep_empty: bool = True) -> DataFrame:
    """For keys (id, image) in two sources or more: the labels that one source alone has, by the number of the source.

    The last row of a key in a source counts; task comes from the first source that has the key.
    """
    rows = None
    for n, df in enumerate(sources):
        d = dedup(df.select("id", "image", "task", "elements", ORD), ["id", "image"], "last")
        d = d.select("id", "image", F.lit(n).alias("src"), "task", ordered_labels(F.col("elements")).alias("labels"))
        rows = d if rows is None else rows.unionByName(d)
    g = rows.groupBy("id", "image").agg(F.sort_array(F.collect_list(F.struct("src", "task", "labels"))).alias("by_src")).filter(F.size("by_src") >= 2)

    def alone(x: Column) -> Column:
        others = F.flatten(F.transform(F.filter("by_src", lambda y: y["src"] != x["src"]), lambda y: F.transform(y["labels"], lambda v: v["key"])))
        own = T.let(others, lambda o: F.filter(x["labels"], lambda v: ~F.array_contains(o, v["key"])))
        return F.struct(x["src"].alias("src"), F.transform(own, lambda v: v["label"]).alias("labels"))

    out = g.select("id", "image", F.get(F.col("by_src"), F.lit(0))["task"].alias("task"), F.transform("by_src", alone).alias("unique_labels"))
    return out if keep_empty else out.filter(F.exists("unique_labels", lambda u: F.size(u["labels"]) > 0))


def merge_by_id(sources: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Full outer merge of several sources by id: of each column the value of the last source and row that has the column.

    Sources lack columns, not values: a null of a later source that has the column overrides an earlier value.
    """
    names = list(dict.fromkeys(c for df in sources for c in df.columns if c not in (id_col, ORD)))
    rows = None
    for n, df in enumerate(sources):
        cells = [(F.struct(F.lit(True).alias("has"), F.col(c).alias("v")) if c in df.columns else F.lit(None)).alias(c) for c in names]
        d = df.select(id_col, F.struct(F.lit(n), F.col(ORD)).alias("at"), *cells)
        rows = d if rows is None else rows.unionByName(d)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))["v"].alias(c) for c in names]
    return rows.groupBy(id_col).agg(*latest)


def pending(manifest: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the manifest whose id is not among the completed ones."""
    return manifest.join(done.select(id_col).distinct(), id_col, "left_anti")


def coverage(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: distinct ids of either side, of both, and missing on either side."""
    x, y = a.select(id_col).distinct().withColumn("in_a", F.lit(1)), b.select(id_col).distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, id_col, "full_outer")
    return j.agg(
        F.count("in_a").alias("a_ids"), F.count("in_b").alias("b_ids"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"),
        F.count_if(F.col("in_b").isNull()).alias("missing_in_b"), F.count_if(F.col("in_a").isNull()).alias("missing_in_a"),
    )


def _by_value(train: DataFrame, validation: DataFrame, columns: Sequence[str], id_col: str | None = None) -> DataFrame:
    """(field, value, t, v): rows of either set with a value, counted before they are shuffled; with an id column the
    smallest id of either set, train_id and validation_id."""
    parts = None
    for name in columns:
        for side, df in ((0, train), (1, validation)):
            own = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
            d = df.select(F.lit(name).alias("field"), F.lit(side).alias("side"), F.col(name).cast("string").alias("value"), own.alias("id"))
            parts = d if parts is None else parts.unionByName(d)
    of = lambda side: F.min(F.when(F.col("side") == side, F.col("id")))
    return parts.groupBy("field", "value").agg(F.count_if(F.col("side") == 0).alias("t"), F.count_if(F.col("side") == 1).alias("v"), of(0).alias("train_id"), of(1).alias("validation_id"))


def isolation(train: DataFrame, validation: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: distinct values, repeats and overlap of the two sets. One pass: sides count map-side by value."""
    has_t, has_v = F.col("t") > 0, F.col("v") > 0
    return _by_value(train, validation, columns).groupBy("field").agg(
        F.count_if(has_t).alias("train_unique"), F.coalesce(F.sum(F.when(has_t, F.col("t") - 1)), F.lit(0)).alias("train_duplicates"),
        F.count_if(has_v).alias("validation_unique"), F.coalesce(F.sum(F.when(has_v, F.col("v") - 1)), F.lit(0)).alias("validation_duplicates"),
        F.count_if(has_t & has_v).alias("overlap"),
    )


def overlap_examples(train: DataFrame, validation: DataFrame, columns: Sequence[str], most: int = 10, id_col: str = "id") -> DataFrame:
    """(field, value, train_id, validation_id): of each column the first ``most`` values that both sets have, in order,
    with the smallest id on either side. The limit is the feature; null values are not compared."""
    shared = _by_value(train, validation, columns, id_col).filter((F.col("t") > 0) & (F.col("v") > 0) & F.col("value").isNotNull())
    out = None
    for name in columns:
        d = shared.filter(F.col("field") == name).orderBy("value").limit(most).select("field", "value", "train_id", "validation_id")
        out = d if out is None else out.unionByName(d)
    return out


def require_isolated(train: DataFrame, validation: DataFrame, columns: Sequence[str], most: int = 10, id_col: str = "id", required: Sequence[str] = ("id", "image")) -> None:
    """ValueError if a required column of a row is empty, a value repeats within a set, or both sets share one; the message
    has the counts of each column and up to ``most`` examples a column."""
    for name, df in (("training", train), ("validation", validation)):
        blank = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in required]
        empty = df.agg(*blank).first().asDict() if required else {}
        if any(empty.values()):
            raise ValueError(f"{name} rows without a value: " + ", ".join(f"{c} {n}" for c, n in empty.items() if n))
    counts = sorted(isolation(train, validation, columns).collect(), key=lambda r: columns.index(r.field))  # a row a column
    if not any(r.train_duplicates or r.validation_duplicates or r.overlap for r in counts):
        return
    lines = [f"{r.field}: {r.overlap} shared, {r.train_duplicates} repeats in training, {r.validation_duplicates} in validation" for r in counts]
    examples = sorted(overlap_examples(train, validation, columns, most, id_col).collect(), key=lambda r: (columns.index(r.field), r.value))
    lines += [f"{r.field} {r.value}: training row {r.train_id}, validation row {r.validation_id}" for r in examples]
    raise ValueError("training and validation rows are not apart\n" + "\n".join(lines))


def base_rows(pending: DataFrame, base: DataFrame, id_col: str = "id") -> DataFrame:
    """Pending samples with their base label row: the columns of ``base``, and from_sample, whether there is none.

    Of base rows with one id the first by ORD counts; an id that is null has no base row.
    """
    first = dedup(base, [id_col]).drop("copies", *([ORD] if ORD in pending.columns else [])).withColumn("__base", F.lit(True))
    rest = [c for c in first.columns if c not in (id_col, "__base") and c not in pending.columns]
    out = pending.join(first.select(id_col, *rest, "__base"), id_col, "left")
    return out.withColumn("from_sample", F.col("__base").isNull()).drop("__base")


def repeated(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): values that more than one row has, null among them; counted before the shuffle."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def numbered_manifest(paths: DataFrame, task: str = "parsing", query: str = "", path_col: str = "path") -> DataFrame:
    """Manifest rows with ids by sorted path. Ids are global positions: rows are range-partitioned and counted by
    partition before they are numbered, so no task sees them all."""
    p = paths.select(F.replace(F.col(path_col), F.lit("\\"), F.lit("/")).alias("image"))
    n = global_position(p, "image")
    return n.select(F.format_string("parsing-%06d", "position").alias("id"), "image", F.lit(task).alias("task"), F.lit(query).alias("query"))


#: Rows that one range of a global order holds, about; a range is sorted in one task.
RANGE_ROWS = 500_000
#: First positions of so many ranges are broadcast, some 16 bytes each; beyond that they are joined by a shuffle.
BROADCAST_RANGES = 500_000


def global_position(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with position: 1-based rank by ``order``, ties in any order.

    Rows are dealt to ranges by sampled split points of whole values, so a long common prefix does no harm, sorted there and
    written with the number of their range and their place in it; then they are counted by range. The number of ranges follows from the
    number of rows. A range holds all rows of a value, so an order that tells rows apart keeps ranges even.
    """
    if ranges is None:
        ranges = max(8, df.count() // RANGE_ROWS + 1)
    d = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    d = written(d, "positions").withColumns({"__range": F.shiftright("__place", 33), "__n": F.col("__place").bitwiseAND((1 << 33) - 1) + 1})
    counts = d.groupBy("__range").count()
    before = counts.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = d.join(F.broadcast(before) if ranges <= BROADCAST_RANGES else before, "__range")
    return out.withColumn("position", F.col("__before") + F.col("__n")).drop("__before", "__n", "__range", "__place")


def by_role(teacher: DataFrame, candidates: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Each teacher row (id, names) with each role: id, role, names, candidate_names, none where the role lacks the id.

    ``candidates`` has (role, id, names) in the order of ORD; of rows of one role and id the last one counts.
    """
    last = dedup(candidates.select("role", "id", "names", ORD), ["role", "id"], keep="last").select("role", "id", F.col("names").alias("candidate_names"))
    pairs = teacher.select("id", "names", F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"))
    return pairs.join(last, ["id", "role"], "left").withColumn("candidate_names", F.coalesce("candidate_names", F.array().cast("array<string>")))


def reused(samples: DataFrame, rows: DataFrame, role: str) -> DataFrame:
    """(id, image, status, elements) of each sample (id, image): what the rows (model_role, id, image, elements) of a role
    hold for it. Statuses, the first that applies: missing, duplicate, image differs, no elements, reused."""
    own = rows.filter(F.col("model_role") == role).groupBy("id").agg(F.count("*").alias("__n"), F.first("image").alias("__image"), F.first("elements").alias("elements"))
    j = samples.select("id", "image").join(own, "id", "left")
    status = (
        F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicate").when(~F.col("__image").eqNullSafe(F.col("image")), "image differs")
        .when(~F.coalesce(F.exists("elements", lambda e: e.isNotNull()), F.lit(False)), "no elements").otherwise("reused")
    )
    return j.select("id", "image", status.alias("status"), F.when(status == "reused", F.col("elements")).alias("elements"))


def striped(df: DataFrame, order: str, ranks: int) -> DataFrame:
    """``df`` with rank: rows in the order of a column dealt round the ranks; no row is repeated to fill a round."""
    return global_position(df, order).withColumn("rank", ((F.col("position") - 1) % ranks).cast("int")).drop("position")


def output_names(rows: DataFrame) -> DataFrame:
    """``rows`` (id, source, ...) with name: of rows that would share one, all but the first get a hash of their source.

    The first of a name is found by a minimum that combines before the shuffle, so a name that many rows share is no task's load.
    """
    base = F.concat_ws("__", T.file_part(F.col("id")), F.coalesce(F.nullif(T.file_part(T.stem(F.col("source"))), F.lit("")), F.lit("image")), F.lit("annotated"))
    based = rows.withColumn("__base", base)
    first = based.groupBy("__base").agg(F.min(ORD).alias("__first"))
    out = based.join(first, "__base")
    name = F.when(F.col(ORD) == F.col("__first"), F.col("__base")).otherwise(F.concat_ws("__", "__base", F.substring(F.sha1("source"), 1, 8)))
    return out.withColumn("name", F.concat(name, F.lit(".png"))).drop("__base", "__first")


def vocab_equality(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, equal, shared_size): whether the vocabularies (by, token, id) have the same tokens with the same ids, and then
    the largest id and one."""
    r = right.select(F.col(by).alias("by"), F.col("token").alias("other"), F.col("id").alias("other_id"))
    both = left.select(by, "token", "id").join(r, (F.col(by) == F.col("by")) & (F.col("token") == F.col("other")), "full_outer")
    same = F.bool_and(F.col("token").isNotNull() & F.col("other").isNotNull() & F.col("id").eqNullSafe(F.col("other_id")))
    out = both.groupBy(F.coalesce(by, "by").alias(by)).agg(same.alias("equal"), F.max("id").alias("top"))
    return out.select(by, "equal", F.when(F.col("equal"), F.col("top") + 1).alias("shared_size"))
