"""Array mathematics over per-position scores: one row a position, array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

SPARSE = "array<struct<idx:int,val:double>>"


def top_k(scores: Column, k: int | Column) -> Column:
    """The k largest as struct(idx, val), descending; equal scores by lowest index."""
    k = F.lit(k) if isinstance(k, int) else k
    ranked = F.slice(F.sort_array(F.transform(scores, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), F.lit(1), k)
    return F.transform(ranked, lambda e: F.struct(e["i"].cast("int").alias("idx"), (-e["v"]).alias("val")))


def dense(sparse: Column, size: Column, missing: float) -> Column:
    """Scores by index from 0, ``missing`` where the sparse form has none; of repeated indices the largest score."""
    at = lambda i: F.array_max(F.transform(F.filter(sparse, lambda e: e["idx"] == i), lambda e: e["val"]))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(at(i), F.lit(missing)))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))))


def log_softmax(scores: Column, temperature: float = 1.0) -> Column:
    t = max(temperature, 1e-6)
    scaled = F.transform(scores, lambda x: x / t)
    return let(scaled, lambda x: let(log_sum_exp(x), lambda z: F.transform(x, lambda v: v - z)))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(scores, temperature), lambda v: F.exp(v))


def entropy(scores: Column, temperature: float = 1.0) -> Column:
    """-sum p ln max(p, 1e-12)."""
    return F.aggregate(softmax(scores, temperature), F.lit(0.0), lambda s, p: s - p * F.ln(F.greatest(p, F.lit(1e-12))))


def entropy_weight(h: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(h, F.lit(0.0)))


def entropy_k(h: Column, base: int, most: int) -> Column:
    """A quarter of the base below 1 nat, the base below 2.5, twice the base above; at least 1, at most ``most``."""
    k = F.when(h < 1.0, base // 4).when(h < 2.5, base).otherwise(2 * base)
    return F.greatest(F.lit(1), F.least(k, F.lit(most)))


def knee_k(scores: Column, candidates: int, least: int, most: int | None = None) -> Column:
    """Number of scores up to the knee of the descending curve of the ``candidates`` largest, clamped."""

    def of(v: Column) -> Column:
        n = F.size(v)
        first, last = F.get(v, F.lit(0)), F.get(v, n - 1)
        spread = F.greatest(first - last, F.lit(1.1920928955078125e-07))
        rank = lambda i: i / F.greatest(n - 1, F.lit(1))
        knee = F.transform(v, lambda x, i: (x - last) / spread - (1.0 - rank(i)))
        top = F.least(n, F.lit(most)) if most is not None else n
        return let(knee, lambda s: F.least(F.greatest(F.array_position(s, F.array_max(s)).cast("int"), F.lit(least)), top))

    return let(F.transform(top_k(scores, candidates), lambda e: e["val"]), of)


def union_indices(a: Column, b: Column) -> Column:
    """Ascending distinct indices of two sparse forms."""
    idx = lambda s: F.transform(s, lambda e: e["idx"])
    return F.sort_array(F.array_union(idx(a), idx(b)))


def gather(scores: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(scores, i))


def divergence(student: Column, reference: Column, temperature: float = 1.0, mode: str = "symmetric") -> Column:
    """KL divergence of two score arrays over the same candidates, times the temperature squared."""

    def of(s: Column) -> Column:
        kl = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)), F.lit(0.0), lambda a, v: a + v)
        forward, reverse = kl(s["r"], s["s"]), kl(s["s"], s["r"])
        out = {"forward": forward, "reverse": reverse, "symmetric": 0.5 * (forward + reverse)}[mode]
        return out * max(temperature, 1e-6) ** 2

    return let(F.struct(log_softmax(student, temperature).alias("s"), log_softmax(reference, temperature).alias("r")), of)


def informative(student: Column, reference: Column, min_prob: float, margin: float, temperature: float = 1.0) -> Column:
    """struct(student, reference): candidates that neither side gives ``min_prob`` fall to the side's least kept score less the margin.

    Without any informative candidate the scores stay as they are.
    """

    def of(s: Column) -> Column:
        keep = F.zip_with(s["ps"], s["pr"], lambda x, y: (x > min_prob) | (y > min_prob))

        def floor(values: Column, kept: Column) -> Column:
            least = F.array_min(F.filter(F.zip_with(values, kept, lambda v, k: F.when(k, v)), lambda v: v.isNotNull()))
            return let(least - margin, lambda f: F.when(f.isNull(), values).otherwise(F.zip_with(values, kept, lambda v, k: F.when(k, v).otherwise(f))))

        return let(keep, lambda k: F.struct(floor(s["s"], k).alias("student"), floor(s["r"], k).alias("reference")))

    return let(F.struct(student.alias("s"), reference.alias("r"), softmax(student, temperature).alias("ps"), softmax(reference, temperature).alias("pr")), of)


def top_divergence(student: Column, reference: Column, k: int, temperature: float = 1.0, mode: str = "symmetric") -> Column:
    """Divergence over the union of both sides' top k."""
    return let(union_indices(top_k(student, k), top_k(reference, k)), lambda u: divergence(gather(student, u), gather(reference, u), temperature, mode))


def sparse_divergence(student: Column, sparse: Column, k: int, margin: float, temperature: float = 1.0, mode: str = "symmetric") -> Column:
    """The same against a sparse reference; a candidate it lacks gets its least score less the margin."""

    def of(u: Column) -> Column:
        floor = F.array_min(F.transform(sparse, lambda e: e["val"])) - margin
        look = lambda i: F.array_max(F.transform(F.filter(sparse, lambda e: e["idx"] == i), lambda e: e["val"]))
        return divergence(gather(student, u), let(floor, lambda f: F.transform(u, lambda i: F.coalesce(look(i), f))), temperature, mode)

    return let(union_indices(top_k(student, k), sparse), of)


def pairwise_differences(values: Column) -> Column:
    """Differences of all pairs i < j, row by row."""
    return let(values, lambda v: F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda y: x - y))))


def pairwise_divergence(student: Column, reference: Column, k: int, temperature: float = 1.0, mode: str = "forward") -> Column:
    """Mean of two branches: divergence over the pairwise differences of the reference's and of the student's top k; k >= 2."""
    if k < 2:
        raise ValueError("pairwise differences need at least two scores")

    def branch(lead: Column) -> Column:
        idx = F.transform(top_k(lead, k), lambda e: e["idx"])
        return let(idx, lambda u: divergence(pairwise_differences(gather(student, u)), pairwise_differences(gather(reference, u)), temperature, mode))

    return branch(reference) + branch(student)


def cross_entropy(scores: Column, label: Column, ignored: int = -100) -> Column:
    """log sum exp less the label's score; null for the ignored label."""
    return F.when(label != ignored, log_sum_exp(scores) - F.get(scores, label))


def suffix_positions(position: Column, reference_prompt: Column, student_prompt: Column) -> Column:
    """Position of a cached row in a sequence with a prompt of other length; null before the answer."""
    return F.when(position >= reference_prompt, position - reference_prompt + student_prompt)


def remap(sparse: Column, shared: int) -> Column:
    """Without the indices beyond the shared vocabulary."""
    return F.filter(sparse, lambda e: e["idx"] < shared)


def first_mismatch(a: Column, b: Column) -> Column:
    """0-based position of the first difference of two arrays; null if equal; the shorter length if one begins the other."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).when(F.size(a) != F.size(b), n.cast("long"))


def context_window(tokens: Column, at: Column, around: int = 5) -> Column:
    """Tokens within ``around`` places of the 0-based position."""
    start = F.greatest(at - around, F.lit(0)).cast("int")
    return F.slice(tokens, start + 1, (at + around + 1 - start).cast("int"))


def padded(values: Column, size: Column, fill) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0))))


def answer_span(full: Column, prompt: Column) -> Column:
    """Answer part of a sequence that must begin with its prompt; null if it does not."""
    return F.when(F.slice(full, F.lit(1), F.size(prompt)) == prompt, F.slice(full, F.size(prompt) + 1, F.size(full)))


def spliced(values: Column, at: Column, inserted: Column) -> Column:
    """``values`` with the one at the 0-based place replaced by all of ``inserted``; a null place changes nothing."""
    head, tail = F.slice(values, F.lit(1), at), F.slice(values, at + 2, F.greatest(F.size(values) - at - 1, F.lit(0)))
    return F.when(at.isNull(), values).otherwise(F.concat(head, inserted, tail))


def accumulation_scale(micro_step: Column, steps: int) -> Column:
    """What turns gradients of an unfinished accumulation window into a mean: 1 at its end and before the first step."""
    rest = micro_step % steps
    return F.when((micro_step <= 0) | (rest == 0), F.lit(1.0)).otherwise(F.lit(float(steps)) / rest)


def contiguous(positions: Column) -> Column:
    return (F.array_max(positions) - F.array_min(positions) + 1) == F.size(positions)


def early_stop(losses: Column, patience: int, min_delta: float = 0.0) -> Column:
    """Fold over losses in order: struct(best, bad, stopped_at), stopped_at the 1-based step at which patience ran out."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stopped_at"), F.lit(0).alias("step"))

    def add(a: Column, x: Column) -> Column:
        better = a["best"].isNull() | (x < a["best"] - min_delta)
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        step = a["step"] + 1
        new = F.struct(F.when(better, x).otherwise(a["best"]).alias("best"), bad.alias("bad"), F.when(bad >= patience, step).alias("stopped_at"), step.alias("step"))
        return F.when(a["stopped_at"].isNotNull(), a).otherwise(new)

    return F.aggregate(losses, start, add, lambda a: F.struct(a["best"].alias("best"), a["bad"].alias("bad"), a["stopped_at"].alias("stopped_at")))
