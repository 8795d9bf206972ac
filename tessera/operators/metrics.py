"""Evaluation metrics: per-sample scores, corpus aggregates, statistics and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import align, match
from tessera.schemas import COORDINATE_SYSTEM, SUMMARY_FIELDS


def token_k_stats(rows: DataFrame, col: str = "token_k") -> DataFrame:
    """min, max and mean of the kept scores a token; null for none."""
    return rows.agg(F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"), F.avg(col).alias("mean"))


def training_summary(rows: DataFrame, teacher: str = "teacher_logits", switch: str = "switch_logits") -> DataFrame:
    """One row: rows, those with a target text and with each payload, and the distinct vocabulary sizes, ascending."""
    sizes = lambda c: F.sort_array(F.collect_set(F.col(f"{c}_vocab_size").cast("long"))).alias(f"{c}_vocab_sizes")
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce("target", F.lit("")) != "").alias("target_rows"),
        *[F.count_if(F.col(c).isNotNull()).alias(f"{c}_rows") for c in (teacher, switch)],
        sizes(teacher),
        sizes(switch),
    )


def drawing_summary(rows: DataFrame, width: int, height: int) -> DataFrame:
    """One row over samples with ``elements``, null where the prediction was not parsed: rows written and failed,
    elements drawn and skipped, the latter also by reason."""
    pixels = lambda e: G.to_pixels(e["bbox_norm"], F.lit(width), F.lit(height))
    malformed = lambda b: F.coalesce((F.size(b) != 4) | F.exists(b, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))), F.lit(True))
    flat = lambda p: (p[0] == p[2]) | (p[1] == p[3])
    reason = lambda e: F.when(e.isNull() | malformed(e["bbox_norm"]), "malformed").when(flat(pixels(e)), "flat").otherwise("drawn")
    t = rows.select(F.col("elements").isNotNull().alias("ok"), F.coalesce(F.transform("elements", reason), F.array().cast("array<string>")).alias("how"))
    n = lambda *kinds: F.coalesce(F.sum(F.size(F.filter("how", lambda x: x.isin(*kinds)))), F.lit(0)).cast("long")
    return t.agg(
        F.count("*").alias("rows_total"), F.count_if("ok").alias("images_written"), F.count_if(~F.col("ok")).alias("rows_parse_failed"),
        n("malformed", "flat", "drawn").alias("elements_total"), n("drawn").alias("elements_drawn"), n("malformed", "flat").alias("elements_skipped"),
        n("malformed").alias("skipped_malformed_bbox"), n("flat").alias("skipped_zero_area"),
    )


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def score_samples(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One row a key of either side: element counts, matches, precision, recall, F1, mean overlap of all text matches.

    Each side is shuffled once, by the row key; deduplication, the outer join and the matching all use that
    partitioning, as matching happens inside the joined row.
    """
    return score_aligned(align.full_outer(pred, ref))


def score_aligned(j: DataFrame) -> DataFrame:
    """``score_samples`` of samples whose sides are aligned: key_kind, key, structs pred and ref of id, elements and copies."""
    j = j.select("key_kind", "key", F.col("pred.id").isNull().alias("missing_prediction"), F.col("ref.id").isNull().alias("missing_reference"),
                 match.usable(F.col("pred.elements")).alias("p"), match.usable(F.col("ref.elements")).alias("r"),
                 F.coalesce(F.col("pred.copies") - 1, F.lit(0)).alias("pred_repeats"), F.coalesce(F.col("ref.copies") - 1, F.lit(0)).alias("ref_repeats"))
    j = j.withColumn("m", match.one_to_one(F.col("p"), F.col("r"))).withColumn("np", F.size("p")).withColumn("nr", F.size("r"))
    return scored(j)


def score_elements(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``score_samples`` of the samples that element rows form: ``rows`` has ``key``, ``order``, and pred and ref, an element of
    either side or null, as for ``align.aligned_elements``.

    A sample is never one row: its elements are rows, dealt and sorted by ``key``, and a task matches one sample after the
    other, so it holds one sample's arrays at a time. ``order`` has to tell rows apart whose elements differ.
    """
    m = align.row_key(match.by_sample(rows, key, order).withColumn("image", F.lit("")))
    none = F.lit(0).cast("long")
    m = m.select("key_kind", "key", "missing_prediction", "missing_reference", F.struct("tp", "iou_sum", "boxes").alias("m"), "np", "nr", none.alias("pred_repeats"), none.alias("ref_repeats"))
    return scored(m)


def scored(j: DataFrame) -> DataFrame:
    """The columns of ``score_samples`` from the matches m of a sample, its usable elements np and nr, and what it lacks or repeats."""
    tp, np_, nr = F.col("m.tp"), F.col("np"), F.col("nr")
    both = (np_ == 0) & (nr == 0)
    precision, recall = F.when(both, 1.0).otherwise(ratio(tp, np_, 0.0)), F.when(both, 1.0).otherwise(ratio(tp, nr, 0.0))
    return j.select(
        "key_kind", "key", nr.alias("reference_element_count"), np_.alias("prediction_element_count"), tp.alias("element_tp"), (np_ - tp).alias("element_fp"),
        (nr - tp).alias("element_fn"), precision.alias("element_precision"), recall.alias("element_recall"), f1(precision, recall).alias("element_f1"),
        ratio(F.col("m.iou_sum"), tp, 0.0).alias("bbox_iou"), F.col("m.boxes").alias("matched_bbox_count"), "missing_prediction", "missing_reference", "pred_repeats", "ref_repeats",
    )


def aggregate_samples(samples: DataFrame, *by: str) -> DataFrame:
    """Micro and macro metrics; corpus precision and recall are 1 on an empty denominator."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    s = samples.groupBy(*by).agg(
        F.count("*").alias("image_count"), total("reference_element_count").alias("reference_element_count"), total("prediction_element_count").alias("prediction_element_count"),
        total("element_tp").alias("element_tp"), total("element_fp").alias("element_fp"), total("element_fn").alias("element_fn"),
        F.coalesce(F.avg("element_precision"), F.lit(0.0)).alias("macro_element_precision"), F.coalesce(F.avg("element_recall"), F.lit(0.0)).alias("macro_element_recall"),
        F.coalesce(F.sum(F.col("bbox_iou") * F.col("element_tp")), F.lit(0.0)).alias("iou_sum"), total("matched_bbox_count").alias("matched_bbox_count"),
    )
    tp, fp, fn = F.col("element_tp"), F.col("element_fp"), F.col("element_fn")
    s = s.withColumn("element_precision", ratio(tp, tp + fp, 1.0)).withColumn("element_recall", ratio(tp, tp + fn, 1.0))
    s = s.withColumn("element_f1", f1(F.col("element_precision"), F.col("element_recall"))).withColumn("bbox_iou", ratio(F.col("iou_sum"), tp, 0.0))
    return s.drop("iou_sum")


def evaluate(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One row: corpus metrics of predictions against references."""
    return aggregate_samples(score_samples(pred, ref))


def evaluation_counts(samples: DataFrame) -> DataFrame:
    """One row: samples scored, matched and missing on either side, keys repeated on either side."""
    mp, mr = F.col("missing_prediction"), F.col("missing_reference")
    return samples.agg(
        F.count("*").alias("num_scored_samples"), F.count_if(~mp & ~mr).alias("matched_samples"), F.count_if(mp).alias("missing_prediction_samples"),
        F.count_if(mr).alias("missing_reference_samples"), F.sum("pred_repeats").alias("duplicate_prediction_keys"), F.sum("ref_repeats").alias("duplicate_reference_keys"),
    )


def evaluate_experiments(experiments: dict[str, DataFrame], ref: DataFrame, reference_name: str | None = "reference") -> DataFrame:
    """One row an experiment in the order given, after the reference against itself if it has a name; the summary's columns."""
    runs = ([(reference_name, ref)] if reference_name else []) + list(experiments.items())
    rows = None
    for n, (name, df) in enumerate(runs):
        s = score_samples(df, ref).withColumn("experiment", F.lit(name)).withColumn("nth", F.lit(n))
        rows = s if rows is None else rows.unionByName(s)
    return aggregate_samples(rows, "nth", "experiment").orderBy("nth").select(*SUMMARY_FIELDS)


#: Words of the schema that count as leaked into labels.
SCHEMA_WORDS = ["text", "focused", "true", "false", "elements", "bbox_norm", "coordinate_system"]


def label_stats(labels: DataFrame) -> DataFrame:
    """One row: element statistics of label rows; repeats are texts seen before in their row, whatever the case."""
    es = F.coalesce(F.col("elements"), F.array().cast(dict(labels.dtypes)["elements"]))
    boxed = F.filter(es, lambda e: G.valid(e["bbox_norm"]) & (F.trim(e["text"]) != ""))
    per = labels.select(
        F.size(es).alias("n"), F.size(F.filter(es, lambda e: (F.trim(e["text"]) != "") & ~G.valid(e["bbox_norm"]))).alias("bad"), F.size(boxed).alias("good"),
        F.size(F.filter(boxed, lambda e: e["focused"])).alias("focused"),
        F.size(F.filter(boxed, lambda e: F.lower(F.trim(e["text"])).isin(SCHEMA_WORDS))).alias("schema_words"),
        (F.size(boxed) - F.size(F.array_distinct(F.transform(boxed, lambda e: F.lower(F.trim(e["text"])))))).alias("repeats"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    s = per.agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("n") > 0).alias("rows_with_elements"), F.count_if(F.col("n") == 0).alias("empty_element_rows"),
        total("good")("total_elements"), total("bad")("invalid_bbox_count"), total("focused")("focused_true_count"), total("schema_words")("schema_word_element_count"),
        total("repeats")("duplicate_text_count"),
    )
    return s.withColumn("avg_elements_per_row", ratio(F.col("total_elements"), F.col("total_samples"), 0.0))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count("*").alias("total_rows"), F.count("elements").alias("rows_with_elements_key"), F.count_if(F.size("elements") > 0).alias("rows_with_elements"))


def teacher_reason(task: str = "task") -> Column:
    """First reason why a label row is invalid; null: valid."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(blank("id"), "id is missing").when(blank("image"), "image is missing").when(F.col("query").isNull(), "query is missing")
        .when((F.trim(F.col(task)) == "parsing") & ~F.coalesce(F.size("elements") > 0, F.lit(False)), "elements is missing or empty")
        .when((F.trim(F.col(task)) == "parsing") & ~F.coalesce(F.col("coordinate_system") == COORDINATE_SYSTEM, F.lit(False)), f"coordinate_system must be {COORDINATE_SYSTEM}")
    )


def validation_summary(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows by reason; valid rows have none."""
    return rows.select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def bad_rows(rows: DataFrame, reason: Column, limit: int = 5, order: str = align.ORD) -> DataFrame:
    """The first invalid rows with their reasons: a report, so the limit is part of it."""
    return rows.select("id", reason.alias("reason"), order).filter("reason is not null").orderBy(order).limit(limit).drop(order)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how the last rows of each id differ in two runs: parse, count, text, box, focus."""
    side = lambda df, n: align.dedup(df.select("id", "elements", align.ORD), ["id"], "last").select("id", F.col("elements").alias(n), F.lit(1).alias(f"has_{n}"))
    j = side(a, "x").join(side(b, "y"), "id", "full_outer")
    ok = F.col("has_x").isNotNull() & F.col("has_y").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    part = lambda arr, f: F.transform(arr, lambda e: e[f])
    differs = lambda f: ok & (F.size("x") == F.size("y")) & ~part(F.col("x"), f).eqNullSafe(part(F.col("y"), f))
    return j.agg(
        F.count("*").alias("total"), F.count_if(ok & F.col("x").eqNullSafe(F.col("y"))).alias("exact"), F.count_if(~ok).alias("parse_mismatch"),
        F.count_if(ok & (F.size("x") != F.size("y"))).alias("count_mismatch"), F.count_if(differs("text")).alias("text_mismatch"),
        F.count_if(differs("bbox_norm")).alias("bbox_mismatch"), F.count_if(differs("focused")).alias("focused_mismatch"),
    )


def role_summary(pairs: DataFrame, by: str = "role") -> DataFrame:
    """Recall and mean similarity by role, from rows (role, similarity, matched)."""
    return pairs.groupBy(by).agg(
        F.count("*").alias("reference_elements"), F.count_if("matched").alias("matched_elements"), F.avg("similarity").alias("mean_similarity"),
        F.avg(F.when(F.col("matched"), F.col("similarity"))).alias("mean_matched_similarity"),
    ).withColumn("recall", ratio(F.col("matched_elements"), F.col("reference_elements"), 0.0))


def parse_histogram(rows: DataFrame, by: str = "role", error: str = "parse_error") -> DataFrame:
    """Rows, errors and elements by role and error code."""
    return rows.groupBy(by, F.coalesce(F.col(error), F.lit("none")).alias(error)).agg(F.count("*").alias("rows"), F.sum("element_count").alias("elements"))


def counts_of(rows: DataFrame, by: str, what: str, name: str) -> DataFrame:
    """(by, name): a map of the values of a column to their rows, null left out."""
    n = rows.filter(F.col(what).isNotNull()).groupBy(by, what).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(what, "n")))).alias(name))


def parse_statistics(rows: DataFrame, by: str = "role") -> DataFrame:
    """One row a role of parsed outputs (role, parsed: elements, parse_error, parse_repair): errors, repairs and boxes with
    their rates, and histograms of the error and repair codes, empty where there are none."""
    r = rows.select(
        by, F.col("parsed").isNull().alias("lost"), F.when(F.col("parsed").isNull(), "missing_parsed_object").otherwise(F.nullif("parsed.parse_error", F.lit(""))).alias("error"),
        F.nullif("parsed.parse_repair", F.lit("")).alias("repair"), F.coalesce(F.size("parsed.elements"), F.lit(0)).alias("n"),
        F.coalesce(F.size(F.filter("parsed.elements", lambda e: e["bbox"].isNotNull())), F.lit(0)).alias("boxed"),
    )
    s = r.groupBy(by).agg(
        F.count("*").alias("num_rows"), F.count("error").alias("num_parse_errors"), F.sum(F.greatest("n", F.lit(0))).alias("total_parsed_elements"), F.count("repair").alias("num_repaired_rows"),
        F.sum(F.greatest("boxed", F.lit(0))).alias("elements_with_valid_bbox"),
    )
    rate = lambda a, b: ratio(F.col(a), F.col(b), 0.0)
    s = s.withColumns({
        "parse_error_rate": rate("num_parse_errors", "num_rows"), "mean_parsed_elements_per_row": rate("total_parsed_elements", "num_rows"),
        "repair_rate": rate("num_repaired_rows", "num_rows"), "valid_bbox_rate": rate("elements_with_valid_bbox", "total_parsed_elements"),
        "elements_with_missing_or_invalid_bbox": F.col("total_parsed_elements") - F.col("elements_with_valid_bbox"),
    })
    for what, name in (("error", "parse_error_counts"), ("repair", "repair_counts")):
        s = s.join(counts_of(r, by, what, name), by, "left").withColumn(name, F.coalesce(name, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))
    return s


def outcome_tally(rows: DataFrame) -> DataFrame:
    """One row over outputs (raw, parsed): answered as they were, after a repair, not parsed, and without any output."""
    none, failed, mended = F.col("raw").isNull(), F.col("parsed.parse_error").isNotNull(), F.col("parsed.parse_repair").isNotNull()
    return rows.agg(
        F.count_if(~none & ~failed & ~mended).alias("success"), F.count_if(~none & ~failed & mended).alias("recovered"),
        F.count_if(~none & failed).alias("parse_failed"), F.count_if(none).alias("runtime_failed"),
    )


#: How parameters of adapters are named, and which targets belong to which branch.
ADAPTER = r"(?i)^(?:.*\.)?model\.language_model\.layers\.(\d+)\.(self_attn|mlp)\.(q_proj|k_proj|v_proj|o_proj|gate_proj|up_proj|down_proj)\.lora_([ab])(?:\.[^.]+)?\.weight$"
PROJECTOR = r"(?i)^(?:.*\.)?model\.visual\.merger\.(?:linear_fc1|linear_fc2)\.lora_[ab](?:\.[^.]+)?\.weight$"
ANY_ADAPTER = r"(?i)(?:^|\.)lora_[ab](?:\.|$)"
BRANCHES = {"self_attn": ("q_proj", "k_proj", "v_proj", "o_proj"), "mlp": ("gate_proj", "up_proj", "down_proj")}


def adapter_parts(name: Column) -> Column:
    """struct(kind, layer, branch, target, component) of a parameter's name; kind attention, mlp, projector, unmatched, or
    null where it is no adapter's."""
    part = lambda i: F.lower(F.regexp_extract(name, ADAPTER, i))
    fits = F.lit(False)
    for branch, targets in BRANCHES.items():
        fits = fits | ((part(2) == branch) & part(3).isin(*targets))
    known = name.rlike(ADAPTER)
    kind = (
        F.when(known & fits, F.when(part(2) == "mlp", "mlp").otherwise("attention")).when(known, "unmatched").when(name.rlike(PROJECTOR), "projector").when(name.rlike(ANY_ADAPTER), "unmatched")
    )
    own = lambda c: F.when(known & fits, c)
    return F.struct(kind.alias("kind"), own(part(1).try_cast("int")).alias("layer"), own(part(2)).alias("branch"), own(part(3)).alias("target"), own(part(4)).alias("component"))


def adapter_inventory(rows: DataFrame) -> DataFrame:
    """One row a kind of the adapter parameters (name, dtype): tensors, logical modules, those that lack a component, dtypes."""
    p = rows.select("name", "dtype", adapter_parts(F.col("name")).alias("p")).filter("p.kind is not null")
    modules = p.filter("p.layer is not null").groupBy("p.kind", "p.layer", "p.branch", "p.target").agg(F.size(F.array_except(F.array(F.lit("a"), F.lit("b")), F.collect_set("p.component"))).alias("lacks"))
    m = modules.groupBy("kind").agg(F.count("*").alias("modules"), F.count_if(F.col("lacks") > 0).alias("incomplete_modules"))
    t = p.groupBy("p.kind").agg(F.count("*").alias("tensors"), F.sort_array(F.collect_set("dtype")).alias("dtypes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(m, "kind", "left").select("kind", "tensors", zero("modules"), zero("incomplete_modules"), "dtypes")


def precision_summary(rows: DataFrame) -> DataFrame:
    """Tensors and values by dtype of parameters (name, dtype, numel), and those of quantised modules and of visual ones among them."""
    four = F.col("dtype").rlike("(?i)4bit|uint8")
    return rows.groupBy("dtype").agg(
        F.count("*").alias("tensors"), F.sum("numel").alias("numel"), F.count_if(four).alias("quantised"), F.count_if(four & F.contains("name", F.lit("visual"))).alias("quantised_visual"))


def legacy_evaluation(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row: every answer against itself; a parsing row fails the query, as it has a metric of its own."""
    t = F.when(F.col("task") == "parsing", F.raise_error(F.lit("parsing rows are evaluated by elements")).cast("string")).otherwise(F.col(text))
    s = rows.select(T.exact_match(t, t).alias("e"), T.token_f1(t, t).alias("f"))
    return s.agg(F.count("*").alias("rows"), F.avg("e").alias("exact_match"), F.avg("f").alias("token_f1"))


def box_aggregate(pairs: DataFrame, *by: str) -> DataFrame:
    """Means over valid box pairs (candidate a, reference b); null where there are none."""
    m = pairs.select(*by, G.pair_metrics(F.col("a"), F.col("b")).alias("m"))
    ok = F.col("m.valid")
    mean = lambda f: F.avg(F.when(ok, F.col(f"m.{f}")))
    return m.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.count_if(ok).alias("valid_pairs"), mean("iou").alias("mean_iou"), mean("center_distance").alias("mean_center_distance"),
        F.avg(F.when(ok, F.abs("m.center_dx"))).alias("mean_abs_dx"), mean("area_error").alias("mean_area_error"), mean("l1").alias("mean_l1"),
    )


def inventory(rows: DataFrame, group: Column, size: str = "numel") -> DataFrame:
    """Entries, total size, first and last name by group."""
    return rows.select(group.alias("group"), "name", size).groupBy("group").agg(
        F.count("*").alias("entries"), F.sum(size).alias("total_size"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def role_delta(rows: DataFrame, value: str, left: object, right: object, role: str = "role", by: str | None = None) -> DataFrame:
    """(by, delta): mean of a value in one role less that in another; null where either role has none."""
    mean = lambda r: F.avg(F.when(F.col(role) == r, F.col(value)))
    groups = rows.groupBy(by) if by else rows.groupBy()
    return groups.agg((mean(left) - mean(right)).alias("delta"))


def masked_loss(rows: DataFrame, loss: str, weight: str, by: str | None = None) -> DataFrame:
    """(by, loss): weighted mean of token losses over all shards, the divisor at least 1; null losses and weights count nothing."""
    groups = rows.groupBy(by) if by else rows.groupBy()
    total = F.coalesce(F.sum(F.col(loss) * F.col(weight)), F.lit(0.0))
    count = F.coalesce(F.sum(F.when(F.col(loss).isNotNull(), F.col(weight))).cast("double"), F.lit(0.0))
    return groups.agg((total / F.greatest(count, F.lit(1.0))).alias("loss"))


def gradient_norms(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, tensors, missing, norm): tensors with and without a gradient, and the root of the sum of squares of those with."""
    v = F.col(value)
    return rows.groupBy(group).agg(F.count(v).alias("tensors"), F.count_if(v.isNull()).alias("missing"), F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))).alias("norm"))


def image_group_stats(elements: DataFrame, group: str, image: str) -> DataFrame:
    """(group, images, elements, focused, invalid) of element rows (bbox_norm, focused); an image belongs to one group.

    Rows are summed up by image first, so nothing distinct is shuffled; null groups are one, null focus is none.
    """
    per = elements.groupBy(group, image).agg(F.count("*").alias("n"), F.count_if(F.coalesce("focused", F.lit(False))).alias("f"), F.count_if(~G.valid(F.col("bbox_norm"))).alias("bad"))
    return per.groupBy(group).agg(F.count("*").alias("images"), F.sum("n").alias("elements"), F.sum("f").alias("focused"), F.sum("bad").alias("invalid"))
