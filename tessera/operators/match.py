"""Element matching within a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import kernels
from tessera.workers import ship

USABLE = "array<struct<text:string,box:array<int>>>"


def usable(elements: Column) -> Column:
    """Elements with a text, normalised, and their box if valid; null: none."""
    kept = F.transform(elements, lambda e: F.struct(T.normalize(e["text"]).alias("text"), G.read(e["bbox_norm"]).alias("box")))
    return F.coalesce(F.filter(kept, lambda e: e["text"] != ""), F.array().cast(USABLE))


def greedy(pred: Column, ref: Column) -> Column:
    """Matches of two arrays of usable elements: struct(tp, iou_sum, boxes).

    Candidates are pairs of equal text. The best overlap goes first, ties by position; an element is used once. Only pairs
    that overlap are sorted and folded; as candidates of different texts share no element, one fold serves all texts. What
    it leaves free does not overlap, so there the n-th free prediction of a text takes the n-th free reference of it, by rank.
    """

    def overlaps(p: Column, i: Column) -> Column:
        at = F.transform(ref, lambda r, j: F.when(r["text"] == p["text"], F.struct((-G.iou(p["box"], r["box"])).alias("v"), i.alias("p"), j.alias("r"))))
        return F.filter(at, lambda c: c["v"] < 0)

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ps"), none.alias("rs"), F.lit(0.0).alias("iou_sum"))

    def add(a: Column, c: Column) -> Column:
        taken = F.array_contains(a["ps"], c["p"]) | F.array_contains(a["rs"], c["r"])
        more = F.struct(F.array_append(a["ps"], c["p"]).alias("ps"), F.array_append(a["rs"], c["r"]).alias("rs"), (a["iou_sum"] - c["v"]).alias("iou_sum"))
        return F.when(taken, a).otherwise(more)

    def free(elements: Column, used: Column, side: int) -> Column:
        left = F.filter(F.transform(elements, lambda e, i: F.struct(e["text"].alias("text"), i.alias("i"), e["box"].isNotNull().alias("box"))), lambda e: ~F.array_contains(used, e["i"]))

        def ranked(es: Column) -> Column:
            texts = F.transform(es, lambda e: e["text"])
            return T.let(texts, lambda ts: F.transform(es, lambda e, i: F.struct(
                e["text"].alias("text"), (i - F.array_position(ts, e["text"])).cast("long").alias("rank"), F.lit(side).alias("side"), e["box"].alias("box"))))

        return T.let(F.sort_array(left), ranked)

    def rest(m: Column) -> Column:
        def paired(all_: Column) -> Column:
            before = lambda i: F.get(all_, i - 1)
            pairs = F.filter(F.transform(all_, lambda x, i: F.when((before(i)["text"] == x["text"]) & (before(i)["rank"] == x["rank"]), (before(i)["box"] & x["box"]).cast("int"))), lambda b: b.isNotNull())
            done = F.size(m["ps"])
            return T.let(pairs, lambda b: F.struct((done + F.size(b)).alias("tp"), m["iou_sum"].alias("iou_sum"), (done + F.size(F.filter(b, lambda x: x == 1))).alias("boxes")))

        return T.let(F.sort_array(F.concat(free(pred, m["ps"], 0), free(ref, m["rs"], 1))), paired)

    found = F.sort_array(F.flatten(F.transform(pred, overlaps)))
    return T.let(F.aggregate(found, start, add), rest)


#: Pairs of a sample up to which its matching is an expression; beyond that it is numpy's.
LARGE = 10_000


def one_to_one(pred: Column, ref: Column) -> Column:
    """``greedy`` for samples of any size: small ones stay in the JVM, where Python gets nulls for them; large ones are
    matched in the Python worker of their task, in memory in proportion to their elements."""
    ship(SparkSession.active())
    large = F.size(pred) * F.size(ref).cast("long") > LARGE
    kernel = F.udf(_matched, "struct<tp:int,iou_sum:double,boxes:int>", useArrow=True)
    return F.coalesce(F.when(~large, greedy(pred, ref)), kernel(F.when(large, pred), F.when(large, ref)))


def _matched(pred, ref):
    return None if pred is None else dict(zip(("tp", "iou_sum", "boxes"), kernels.greedy(pred, ref)))


def by_sample(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``one_to_one`` of samples whose elements are rows with ``key``, ``order``, and pred and ref (text, bbox_norm) or null:
    id (the key), np and nr (usable elements), tp, iou_sum, boxes, missing_prediction, missing_reference.

    What is usable is told row by row in the JVM. Spark sorts the rows by ``key`` on disk if need be and hands a task one
    sample at a time, as arrays; so neither the JVM nor the worker holds more than one sample, however many a task has.
    """
    ship(rows.sparkSession)

    def side(name: str) -> list[Column]:
        box = G.read(F.col(name)["bbox_norm"])
        return [F.col(name).isNotNull().alias(f"{name}_has"), F.nullif(T.normalize(F.col(name)["text"]), F.lit("")).alias(f"{name}_text"),
                *[F.coalesce(F.get(box, F.lit(i)), F.lit(0)).alias(f"{name}_{i}") for i in range(4)]]

    flat = rows.select(F.col(key).alias("id"), *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], *side("pred"), *side("ref"))
    kind = flat.schema["id"].dataType.simpleString()
    return flat.groupBy("id").applyInArrow(_sample, f"id {kind}, np int, nr int, tp int, iou_sum double, boxes int, missing_prediction boolean, missing_reference boolean")


def _sample(key, rows):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    by = [(c, "ascending") for c in rows.column_names if c.startswith("order_")]
    rows = rows.take(pc.sort_indices(rows, by, null_placement="at_start")) if by else rows
    texts = pa.chunked_array([*rows["pred_text"].chunks, *rows["ref_text"].chunks]).combine_chunks().dictionary_encode()
    texts = pc.fill_null(texts.indices, -1).to_numpy()
    sides = []
    for name, text in (("pred", texts[:len(rows)]), ("ref", texts[len(rows):])):
        sides += [text[text >= 0], np.column_stack([rows[f"{name}_{i}"].to_numpy() for i in range(4)])[text >= 0]]
    tp, total, boxes = kernels.greedy_arrays(*sides)
    lacks = [not pc.any(rows[f"{name}_has"]).as_py() for name in ("pred", "ref")]
    out = {"np": len(sides[0]), "nr": len(sides[2]), "tp": tp, "iou_sum": total, "boxes": boxes}
    return pa.table({"id": pa.array([key[0].as_py()], key[0].type), **{k: pa.array([v], pa.float64() if k == "iou_sum" else pa.int32()) for k, v in out.items()},
                     "missing_prediction": lacks[:1], "missing_reference": lacks[1:]})


def by_similarity(refs: Column, candidates: Column, threshold: float) -> Column:
    """For each reference name in turn the most similar unused candidate: array of struct(ref, best, similarity, matched).

    best and similarity are reported also below the threshold; equal similarities go to the earlier candidate. Names are
    normalised in the JVM and compared by numpy, a name with all distinct candidates at once; null arrays give null.
    """
    ship(SparkSession.active())

    def matched(refs, candidates, own_refs, own_candidates):
        return None if refs is None or candidates is None else list(kernels.by_similarity(refs, candidates, own_refs, own_candidates, threshold))

    rows = F.udf(matched, "array<struct<ref:string,best:string,similarity:double,matched:boolean>>", useArrow=True)
    return rows(refs, candidates, F.transform(refs, T.strong_normalize), F.transform(candidates, T.strong_normalize))
