"""Labelling and prediction over a manifest: resume, generate, parse, keep what is usable.

Backends are objects with ``answer(row: dict) -> str``; rows reach them in Arrow batches. The mock backend is native.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonparse as J
from tessera.functions import text as T
from tessera.operators import align
from tessera.schemas import COORDINATE_SYSTEM
from tessera.scratch import written
from tessera.workers import ship


class Backend(Protocol):
    def answer(self, row: dict) -> str: ...


def manifest_reason(task: str = "parsing") -> Column:
    """First reason why a manifest row is invalid; null: valid."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.when(blank("id"), "id is missing").when(blank("image"), "image is missing").when(blank("task"), "task is missing").when(F.col("task") != task, f"task must be {task}")


#: Keys of a manifest row that are not metadata.
KNOWN_KEYS = ("id", "image", "task", "query", "answer", "metadata")


def projected(manifest: DataFrame, files: DataFrame, task: str = "parsing") -> DataFrame:
    """(id, image, task, query, answer, metadata, reason): other columns go into the metadata, over its own entries; null
    ones are left out. ``reason`` says why a row is invalid, a missing image file among others."""
    extra = [c for c in manifest.columns if c not in (*KNOWN_KEYS, align.ORD)]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if extra else none
    given = F.coalesce(F.col("metadata"), none) if "metadata" in manifest.columns else none
    kept = F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    there = files.select(F.col("path").alias("__file")).distinct()
    j = manifest.join(there, F.col("image") == F.col("__file"), "left")
    reason = F.coalesce(manifest_reason(task), F.when(F.col("__file").isNull(), F.lit("image not found")))
    names = [c if c in manifest.columns else F.lit(None).cast("string").alias(c) for c in ("id", "image", "task", "query", "answer")]
    return j.select(*names, F.map_concat(kept, own).alias("metadata"), reason.alias("reason"))


def two_phase(rows: DataFrame, first, second, key: str = "id") -> DataFrame:
    """``second`` of the rows and a cache of ``first`` by key: the first model's pass is written before the second begins,
    so only one is loaded at a time, and ids that repeat are passed once."""
    cache = written(first(rows.dropDuplicates([key])), "first-pass")
    return second(rows.join(cache, key))


def missing_images(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose image is not among the files."""
    return manifest.join(files.select(F.col("path").alias("image")).distinct(), "image", "left_anti")


def prompt(template: str) -> Column:
    """The template with {query} and {task} filled in; doubled braces stand for themselves."""
    out = F.replace(F.replace(F.lit(template), F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for name in ("query", "task"):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    return F.translate(out, "\u0001\u0002", "{}")


def retry_prompt(text: Column) -> Column:
    """The prompt of a second try: what went wrong, then the prompt as it was."""
    return F.concat(F.lit("The last answer could not be read as JSON. Follow the instructions below again, and answer with JSON alone.\n\n"), text)


def mock_answers(rows: DataFrame) -> DataFrame:
    """``rows`` with raw: one element named after the query; the box follows from the hash of the id."""
    at = F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")
    e = F.array(F.struct(F.coalesce(F.nullif("query", F.lit("")), F.lit("target")).alias("text"), F.array(at, at, at + 50, at + 20).alias("bbox_norm"), F.lit(False).alias("focused")))
    return rows.withColumn("raw", J.serialized(e))


def generate(rows: DataFrame, backend: Backend | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with raw, the backend's answers: of an object row by row, of a function for all rows at once; without a
    backend the mock's."""
    if backend is None:
        return mock_answers(rows)
    if not hasattr(backend, "answer"):
        return backend(rows)
    ship(rows.sparkSession)

    def run(frames):
        for f in frames:
            yield f.assign(raw=[backend.answer(r) for r in f.to_dict("records")])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("raw", StringType())]))


def existing_answer(rows: DataFrame) -> Column:
    """The serialised annotation of a parsing row that has elements, else its answer if it says something, else null: such
    rows need no backend. Columns that ``rows`` lacks count as null."""
    own = F.lit(None).cast("string")
    if "elements" in rows.columns:
        own = F.when((F.trim(F.coalesce(F.col("task"), F.lit(""))) == "parsing") & (F.size("elements") > 0), J.serialized(F.col("elements")))
    return F.coalesce(own, F.nullif("answer", F.lit(""))) if "answer" in rows.columns else own


def label(manifest: DataFrame, done: DataFrame | None = None, backend: Backend | Callable[[DataFrame], DataFrame] | None = None, retries: int = 0, template: str = "{query}") -> DataFrame:
    """Strict label rows of the manifest rows that are not done and whose answers are usable.

    Rows that hold an annotation or an answer are not asked about. The others go to the backend with their prompt; an
    answer without a usable element is asked for again up to ``retries`` times, each time with the prompt that says so.
    What a backend answered is written before it is judged, so no answer is paid for twice.
    """
    todo = align.pending(manifest, done) if done is not None else manifest
    keys = ("id", "image", "task", "query")
    todo = todo.select(*keys, existing_answer(todo).alias("own"))
    out = J.parse_answers(todo.filter(F.col("own").isNotNull()).select(*keys, F.col("own").alias("raw")), "raw")
    asked = todo.filter(F.col("own").isNull()).select(*keys).withColumn("prompt", prompt(template))
    for left in range(retries, -1, -1):
        parsed = J.parse_answers(generate(asked, backend).select(*keys, "prompt", "raw"), "raw")
        if left or backend is not None:
            parsed = written(parsed, "answers")
        out = out.unionByName(parsed.drop("prompt"))
        if left:
            asked = parsed.filter(~F.col("parsed.usable")).select(*keys, retry_prompt(F.col("prompt")).alias("prompt"))
    return out.filter("parsed.usable").select(*keys, "parsed.elements", F.lit(COORDINATE_SYSTEM).alias("coordinate_system"))


def confident(rows: DataFrame, least: float, col: str = "teacher_confidence") -> DataFrame:
    return rows.filter(F.col(col).isNull() | (F.col(col) >= least))


def training_rows(labels: DataFrame) -> DataFrame:
    """Parsing rows need elements; their coordinate system is set. Other tasks pass."""
    parsing = F.col("task") == "parsing"
    kept = labels.filter(~parsing | F.coalesce(F.size("elements") > 0, F.lit(False)))
    return kept.withColumn("coordinate_system", F.when(parsing, F.lit(COORDINATE_SYSTEM)).otherwise(F.col("coordinate_system")))


def legacy_rows(rows: DataFrame, drop_target: bool = True) -> DataFrame:
    """teacher_answer from student_target where it lacks; a row with neither fails the query."""
    answer = F.coalesce("teacher_answer", "student_target")
    out = rows.withColumn("teacher_answer", F.when(answer.isNull(), F.raise_error(F.concat(F.lit("no answer for id "), F.col("id")))).otherwise(answer))
    return out.drop("student_target") if drop_target else out


def canonical_text(raw: Column) -> Column:
    return T.strip_special(T.unix_lines(raw))
