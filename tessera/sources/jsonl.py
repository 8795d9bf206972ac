"""JSON Lines: rows with the number of their line, an early stop, and errors that name the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.align import ORD
from tessera.schemas import LABEL
from tessera.scratch import written

#: At most so many blocks of files are broadcast with what comes before them; beyond that they are joined by a shuffle.
BROADCAST_BLOCKS = 500_000
MARK = "\ufeff"
BLANK = rf"(?U)^[\s\x1c-\x1f{MARK}]*$"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, text): the lines of text files that are not blank, numbered from 1 within their file, without a byte order mark.

    Files are read in blocks by many tasks. The rows of a block come in order, so its first row id tells the place of the
    others; a first pass counts the lines of each block, which gives those before a block. Texts are not shuffled. If
    the blocks are cut in another way by the second pass, as the cluster grew meanwhile, the query fails.
    """
    read = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    blocks = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(blocks.select("file", "block", (F.coalesce(F.sum("n").over(above), F.lit(0)) - F.col("first") + 1).alias("shift")), "line-starts")
    known = F.broadcast(starts) if starts.count() <= BROADCAST_BLOCKS else starts
    shift = F.coalesce(F.col("shift"), F.raise_error(F.concat(F.lit("blocks of files changed between two passes: "), "file")).cast("long"))
    out = read.join(known, ["file", "block"], "left").select("file", (F.col("at") + shift).alias("line"), "text")
    bare = F.when(F.col("line") == 1, F.regexp_replace("text", f"^{MARK}", "")).otherwise(F.col("text"))
    return out.filter(~F.regexp_like("text", F.lit(BLANK))).select("file", "line", F.regexp_replace(bare, "\r$", "").alias("text"))


def first_files(spark: SparkSession, path: str, least: int) -> list[str]:
    """The first files by path that hold ``least`` lines that are not blank, or all: read in steps of twice as many files."""
    files, n, found = sorted(spark.read.text(path).inputFiles()), 0, 0
    while n < len(files) and found < least:
        more = files[n : max(1, 2 * n)]
        found += spark.read.option("lineSep", "\n").text(more).filter(~F.regexp_like("value", F.lit(BLANK))).count()
        n += len(more)
    return files[:n]


def read_jsonl(spark: SparkSession, path: str, schema: str = LABEL, max_samples: int | None = None, strict: bool = True) -> DataFrame:
    """Rows of JSON Lines files in the order of file and line; blank lines are skipped.

    A line that is not JSON of the schema fails the query with its file and number, or gives null columns and its text in
    _bad. With ``max_samples`` the first rows in order, and only the files that hold them are read.
    """
    if max_samples is None:
        rows = lines(spark, path)
    else:
        files = first_files(spark, path, max_samples)
        rows = lines(spark, files or path).orderBy("file", "line").limit(max_samples)
    parsed = rows.select("file", "line", F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "text")
    # null: the line holds another kind of value than an object
    bad = F.when(F.col("r").isNull(), F.col("text")).otherwise(F.col("r._bad"))
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name != "_bad"]
    value = F.col("r")
    if strict:  # in every column, so that no selection leaves the check out
        why = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" is malformed JSON"))
        value = F.when(bad.isNotNull(), F.raise_error(why).cast(parsed.schema["r"].dataType)).otherwise(value)
    out = parsed.select(value.alias("r"), bad.alias("_bad"), F.struct("file", "line").alias(ORD))
    out = out.select(*(F.col(f"r.{c}").alias(c) for c in names), "_bad", ORD)
    return out.drop("_bad") if strict else out
