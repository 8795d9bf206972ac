"""Cached reference scores made ready for a student: vocabulary policy, alignment to its sequence, token weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Fixed value: the score of a candidate that does not count.
INACTIVE = -1.0e4
POSITION = "array<struct<idx:int,val:double>>"


def remapped(position: Column, copied: Column) -> Column:
    """A position's candidates for a smaller vocabulary: those from ``copied`` on stay in place, inactive, at its last index."""
    return F.transform(position, lambda e: F.struct(F.least(e["idx"], copied - 1).alias("idx"), F.when(e["idx"] < copied, e["val"]).otherwise(F.lit(INACTIVE)).alias("val")))


def aligned(values: Column, length: Column, start: Column, first: Column, pad: Column) -> Column:
    """``length`` places: from ``first`` on what ``values`` has from ``start`` on, ``pad`` elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: F.when((i >= first) & (i < length), F.coalesce(F.get(values, (i - first + start).cast("int")), pad)).otherwise(pad))


def prepared(rows: DataFrame, shared: int | None = None, skip: bool = True, align: bool = True) -> DataFrame:
    """``rows`` with status, positions, token_k and weights of their reference scores, ready for a student.

    Columns: scores (an array of positions, each candidates struct(idx, val)), vocab_size of the scores, student_vocab,
    length of the student's sequence, prompt_len and student_prompt_len, and, where they exist, token_k and token_weight
    by position. Status: absent (no scores), same, remapped (to the ``shared`` vocabulary, where that is known), or
    skipped; without ``skip`` a mismatch that cannot be remapped fails the query. With ``align`` the answer of the scores,
    behind their prompt, goes where the student's answer begins, else places match from the first; either prompt null
    does the same. A prompt as long as the scores counts as none. Places without scores have inactive candidates, a
    token_k and a weight of 0. Skipped and absent rows have nulls.
    """
    scores, vocab, student = F.col("scores"), F.col("vocab_size"), F.col("student_vocab")
    copied = F.least(F.lit(shared).cast("int"), vocab, student) if shared is not None else F.lit(None).cast("int")
    copied = F.when(vocab.isNotNull() & F.lit(shared is not None), copied)
    why = F.concat(F.lit("reference vocabulary of "), F.coalesce(vocab.cast("string"), F.lit("unknown size")), F.lit(" does not match the student's of "), student.cast("string"))
    mismatch = F.lit("skipped") if skip else F.raise_error(why).cast("string")
    status = F.when(scores.isNull(), "absent").when(vocab.eqNullSafe(student), "same").when(F.coalesce(copied > 0, F.lit(False)), "remapped").otherwise(mismatch)
    out = rows.withColumn("status", status).withColumn("__copied", copied)

    kept = F.when(F.col("status") == "same", scores).when(F.col("status") == "remapped", F.transform(scores, lambda p: remapped(p, F.col("__copied"))))
    own_k = F.transform(scores, lambda p: F.size(p))
    valid_k = F.transform(scores, lambda p: F.size(F.filter(p, lambda e: e["idx"] < F.col("__copied"))))
    given_k = F.coalesce(F.col("token_k"), own_k) if "token_k" in rows.columns else own_k
    token_k = F.when(F.col("status") == "same", given_k).when(F.col("status") == "remapped", F.zip_with(given_k, valid_k, lambda a, b: F.least(a, b)))

    size = F.size(scores)
    prompt = F.when(F.col("prompt_len") >= size, 0).otherwise(F.col("prompt_len")) if align else F.lit(None).cast("int")
    both = prompt.isNotNull() & F.col("student_prompt_len").isNotNull()
    start, first = F.when(both, prompt).otherwise(0), F.when(both, F.col("student_prompt_len")).otherwise(0)
    width = F.coalesce(F.array_max(own_k), F.lit(0))
    pad = F.array_repeat(F.struct(F.lit(0).alias("idx"), F.lit(INACTIVE).alias("val")), width)
    out = out.withColumn("__start", start).withColumn("__first", first).withColumn("__pad", pad)
    usable = F.col("status").isin("same", "remapped")
    at = lambda v, p: F.when(usable, aligned(v, F.col("length"), F.col("__start"), F.col("__first"), p))
    out = out.withColumn("positions", at(kept, F.col("__pad"))).withColumn("__k", at(token_k, F.lit(0)))
    if "token_weight" in rows.columns:
        out = out.withColumn("weights", F.when(F.col("token_weight").isNotNull(), at(F.col("token_weight"), F.lit(0.0))))
    return out.drop("token_k").withColumnRenamed("__k", "token_k").drop("__copied", "__start", "__first", "__pad")


# ---- what a row is trained on


def _ids(df: DataFrame, name: str) -> Column:
    """A column of ids as one list: of a list of lists the first; absent: null."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("array<int>")
    first = F.coalesce(F.get(F.col(name), F.lit(0)), F.array().cast("array<int>")) if kind.startswith("array<array") else F.col(name)
    return F.when(F.col(name).isNotNull(), first.cast("array<int>"))


def answer_tokens(df: DataFrame, out: str = "tokens", strict: bool = False) -> DataFrame:
    """``df`` with the answer's token ids: of a parsing row those cached beside its teacher scores, then beside its switch
    scores; else teacher_tokens, then teacher_generated_ids; none: empty. ``strict``, as the validator: generated ids do
    not count, and a list with a null is empty. Columns that ``df`` lacks count as null."""
    parsing = F.trim(F.coalesce(F.col("task"), F.lit(""))) == "parsing"
    cached = F.coalesce(_ids(df, "teacher_logits_answer_token_ids"), _ids(df, "switch_logits_answer_token_ids"))
    rest = [_ids(df, "teacher_tokens")] + ([] if strict else [_ids(df, "teacher_generated_ids")])
    empty = F.array().cast("array<int>")
    tokens = F.coalesce(F.when(parsing, cached), *rest, empty)
    return df.withColumn(out, let(tokens, lambda t: F.when(F.exists(t, lambda x: x.isNull()), empty).otherwise(t)) if strict else tokens)


def target_text(df: DataFrame, out: str = "target", online: bool = False) -> DataFrame:
    """``df`` with the text a row is trained on: the serialised elements of a parsing row, else its teacher's answer, trimmed.

    ``online``: a row without a teacher's answer falls back to ``answer``, and a parsing row without elements fails the query.
    """
    from tessera.functions.jsonparse import serialized

    parsing = F.trim(F.coalesce(F.col("task"), F.lit(""))) == "parsing"
    label = serialized(F.coalesce(F.col("elements"), F.array().cast(dict(df.dtypes)["elements"])))
    names = [c for c in (("teacher_answer", "answer") if online else ("teacher_answer",)) if c in df.columns]
    other = F.trim(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names], F.lit("")))
    if online:
        empty = parsing & ~F.coalesce(F.size("elements") > 0, F.lit(False))
        label = F.when(empty, F.raise_error(F.concat(F.lit("no elements to train on: "), F.coalesce(F.col("id").cast("string"), F.lit(""))))).otherwise(label)
    return df.withColumn(out, F.when(parsing, label).otherwise(other))


def joined(prompt: Column, answer: Column) -> Column:
    """Prompt and answer with a blank between, unless the prompt ends in one or in a line feed; no answer: the prompt."""
    gap = F.when(prompt.endswith(" ") | prompt.endswith("\n"), "").otherwise(" ")
    return F.when(F.coalesce(answer, F.lit("")) == "", prompt).otherwise(F.btrim(F.concat(prompt, gap, answer), F.lit(" \t\n\r\x0b\x0c")))
