"""Row validators: Column expressions of the first reason why a row is invalid, null for valid ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_reason() -> Column:
    """Compact scores (indices, values: [batch][sequence][k]; shape; vocab_size; tokens)."""
    i, v, shape, vocab = F.col("indices"), F.col("values"), F.col("shape"), F.col("vocab_size")
    sizes = lambda a: F.transform(F.flatten(a), lambda x: F.size(x))
    like = (F.size(i) == F.get(shape, F.lit(0))) & F.forall(i, lambda s: F.size(s) == F.get(shape, F.lit(1))) & F.forall(sizes(i), lambda n: n <= F.get(shape, F.lit(2)))
    return (
        F.when(i.isNull() | v.isNull(), "payload is missing")
        .when(~F.coalesce(vocab > 0, F.lit(False)), "vocab_size must be positive")
        .when(~F.coalesce((F.size(shape) == 3) & F.forall(shape, lambda n: n > 0), F.lit(False)), "shape must have three positive numbers")
        .when(sizes(i) != sizes(v), "indices and values differ in shape")
        .when(~like, "payload does not have the stated shape")
        .when(F.exists(F.flatten(F.flatten(i)), lambda x: (x < 0) | (x >= vocab)), "index is out of range")
        .when(F.exists(F.flatten(F.flatten(v)), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "value is not finite")
        .when(F.size("tokens") != F.get(shape, F.lit(1)), "sequence length differs from the tokens")
    )


def switch_reason(field: str = "switch_logits") -> Column:
    """First reason why a row with compact scores is invalid; null: valid.

    Columns: id, teacher_tokens; of the field its struct (shape, indices, values, vocab_size, token_k, entropy,
    entropy_weight) and its flags aligned_to_answer, token_identity_match, vocab_size and answer_token_ids, each named
    ``<field>_<flag>``.
    """
    p, flag = F.col(field), lambda n: F.col(f"{field}_{n}")
    tokens = F.coalesce(F.when(F.size("teacher_tokens") > 0, F.col("teacher_tokens")), flag("answer_token_ids"))
    length, vocab = F.size(tokens), flag("vocab_size")
    shape = lambda i: F.get(p["shape"], F.lit(i))
    batch, i, v = shape(0), p["indices"], p["values"]
    each = lambda f: F.exists(F.zip_with(F.flatten(i), F.flatten(v), lambda a, b: f(a, b)), lambda x: x)
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    out = (
        F.when(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) == "", "id is missing")
        .when(tokens.isNull() | (length <= 0), "target token ids are missing")
        .when(p.isNull(), f"{field} is missing")
        .when(wrong(flag("aligned_to_answer")), f"{field} is not aligned to the answer")
        .when(wrong(flag("token_identity_match")), f"{field} tokens are not marked as identical")
        .when(vocab.isNull(), f"{field} vocab_size is missing")
        .when(vocab <= 0, f"{field} vocab_size must be positive")
        .when(flag("answer_token_ids").isNull(), f"{field} answer tokens are missing")
        .when(~flag("answer_token_ids").eqNullSafe(F.coalesce("teacher_tokens", F.array().cast("array<int>"))), f"{field} answer tokens differ")
        .when(p["shape"].isNull(), f"{field} shape is missing")
        .when(i.isNull(), f"{field} indices are missing")
        .when(v.isNull(), f"{field} values are missing")
        .when(F.size(p["shape"]) != 3, f"{field} shape must have three numbers")
        .when(F.exists(p["shape"], lambda n: n.isNull()), f"{field} shape must hold integers")
        .when(F.exists(p["shape"], lambda n: n <= 0), f"{field} shape must be positive")
        .when(shape(1) != length, f"{field} length differs from the tokens")
        .when(F.coalesce(p["vocab_size"], vocab) <= 0, f"{field} payload vocab_size must be positive")
        .when(F.coalesce(p["vocab_size"], vocab) != vocab, f"{field} vocab_size differs")
        .when((F.size(i) != batch) | (F.size(v) != batch), f"{field} batch differs")
        .when(F.exists(i, lambda s: F.size(s) != length) | F.exists(v, lambda s: F.size(s) != length), f"{field} positions differ from the tokens")
        .when(each(lambda a, b: F.size(a) != F.size(b)), f"{field} top-k lengths differ")
        .when(each(lambda a, b: F.size(a) <= 0), f"{field} top-k is empty")
        .when(F.exists(F.flatten(F.flatten(i)), lambda x: x.isNull() | (x < 0) | (x >= vocab)), f"{field} index is out of range")
    )
    for name in ("token_k", "entropy", "entropy_weight"):
        m = p[name]
        out = out.when(m.isNotNull() & (F.size(m) != batch), f"{field} {name} batch differs").when(F.exists(m, lambda s: F.size(s) != length), f"{field} {name} length differs")
    return out


def pruned(rows: DataFrame, reason: Column) -> DataFrame:
    """The rows of a finished output that are valid: what a rewrite keeps before a run resumes."""
    return rows.filter(reason.isNull())


def key_reason(raw: Column, keys: tuple[str, ...]) -> Column:
    """Reason why the keys of a JSON object are not exactly those; null: they are."""
    have = F.json_object_keys(raw)
    want = F.array(*[F.lit(k) for k in keys])
    return F.when(have.isNull(), "row is not a JSON object").when(F.size(F.array_except(want, have)) > 0, "keys are missing").when(F.size(F.array_except(have, want)) > 0, "keys are not expected")


def training_reason(forbidden: tuple[str, ...] = ()) -> Column:
    """Training rows (id, image, query, target); ``forbidden`` columns must be null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = F.when(blank("id"), "id is missing").when(blank("image"), "image is missing").when(F.col("query").isNull(), "query is missing").when(blank("target"), "target text is missing")
    for name in forbidden:
        out = out.when(F.col(name).isNotNull(), f"{name} is not allowed here")
    return out


def contract(have: Column, want: Column) -> Column:
    """struct(missing, unexpected) of two sets of names."""
    return F.struct(F.sort_array(F.array_except(want, have)).alias("missing"), F.sort_array(F.array_except(have, want)).alias("unexpected"))
