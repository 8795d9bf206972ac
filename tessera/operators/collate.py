"""Batches of sequences: rows of about equal length together, each batch padded to its own longest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.align import global_position

#: What pads labels and masks, and what marks a label that is not trained on.
IGNORED, OFF = -100, 0


def supervised(ids: Column, prompt: Column) -> Column:
    """Labels of a sequence: its ids, those of the first ``prompt`` places ignored; a null prompt is none."""
    n = F.coalesce(prompt, F.lit(0))
    return F.transform(ids, lambda x, i: F.when(i < n, F.lit(IGNORED)).otherwise(x))


def batches(rows: DataFrame, tokens: int, ids_col: str = "input_ids", prompt_col: str = "prompt_token_len", id_col: str = "id", step: int = 64) -> DataFrame:
    """``rows`` (id, input_ids, prompt_token_len, ...) with class, batch and longest: a padded batch has at most ``tokens``
    places, or one row.

    A class holds the lengths up to the next multiple of ``step``; within it rows are numbered by a global order, so a
    class with most of the rows is still many ranges. A batch takes as many rows as fit at the full length of its class.
    Null ids arrays count as empty; null ids are allowed, ties go in any order.
    """
    length = F.coalesce(F.size(ids_col), F.lit(0))
    size = F.greatest(F.ceil(F.greatest(length, F.lit(0)) / step), F.lit(1)).cast("long")
    placed = global_position(rows.withColumn("class", size), "class", id_col)
    counts = placed.groupBy("class").count()
    start = F.coalesce(F.sum("count").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a class
    starts = counts.select("class", start.alias("__start"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(tokens) / (F.col("class") * step))).cast("long")
    return placed.join(starts, "class").withColumn("batch", F.floor((F.col("position") - F.col("__start") - 1) / fits)).drop("position", "__start")


def collated(rows: DataFrame, tokens: int, pad: int = 0, ids_col: str = "input_ids", prompt_col: str = "prompt_token_len", id_col: str = "id", step: int = 64) -> DataFrame:
    """One row a batch: class, batch, ids, longest, input_ids, attention_mask, labels (a list a row), real_tokens.

    Rows go by id within a batch. Padding is behind a row: ``pad`` for ids, 0 for the mask, -100 for labels.
    """
    dealt = batches(rows, tokens, ids_col, prompt_col, id_col, step)
    row = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("x"), F.col(prompt_col).alias("prompt"))
    made = dealt.groupBy("class", "batch").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    made = made.withColumn("longest", F.array_max(F.transform("rows", lambda r: F.size(r["x"]))))

    def padded(value: Column, with_: int) -> Column:
        return F.concat(value, F.array_repeat(F.lit(with_), F.col("longest") - F.size(value)))

    return made.select(
        "class", "batch", F.transform("rows", lambda r: r["id"]).alias("ids"), "longest",
        F.transform("rows", lambda r: padded(r["x"], pad)).alias("input_ids"),
        F.transform("rows", lambda r: padded(F.transform(r["x"], lambda _: F.lit(1)), OFF)).alias("attention_mask"),
        F.transform("rows", lambda r: padded(supervised(r["x"], r["prompt"]), IGNORED)).alias("labels"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.size(r["x"])).alias("real_tokens"),
    )


def unpadded(batch: DataFrame) -> DataFrame:
    """(id, input_ids, labels) of each row of collated batches, without their padding."""
    rows = batch.select(F.explode(F.arrays_zip("ids", "input_ids", "attention_mask", "labels")).alias("r"))
    n = F.aggregate("r.attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select(F.col("r.ids").alias("id"), F.slice("r.input_ids", F.lit(1), n).alias("input_ids"), F.slice("r.labels", F.lit(1), n).alias("labels"))
