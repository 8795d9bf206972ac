"""Sources and sinks: JSON Lines, image folders, reports, profile logs."""

from __future__ import annotations

import csv
import hashlib
import json
from io import StringIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.align import ORD
from tessera.schemas import LABEL
from tessera.scratch import write_text
from tessera.sources.jsonl import read_jsonl

__all__ = ["append_jsonl", "content_hashes", "gpu_rows", "ids_hash", "image_files", "merge_shards", "read_jsonl", "write_jsonl", "write_report", "write_summary"]

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "webp")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls included; the commit protocol makes the whole directory appear at once."""
    df.drop(ORD).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def image_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length) of the images of a folder, whatever the case of their extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length").filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_TYPES))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def ids_hash(df: DataFrame, id_col: str = "id", order: str = ORD) -> tuple[int, str]:
    """Number of rows and SHA-256 of the ids in order, one a line.

    Such a digest is sequential by nature: ids are sorted by the executors and pass the driver one partition at a time.
    """
    h, n = hashlib.sha256(), 0
    for row in df.select(F.col(id_col).cast("string").alias("id"), order).orderBy(order, "id").select("id").toLocalIterator():
        h.update(("\n" if n else "").encode() + (row.id or "").encode())
        n += 1
    return n, h.hexdigest()


def write_report(path: str, **parts) -> None:
    """One indented JSON document, from small values and one-row frames; an old one is replaced whole."""
    value = {k: (v.first().asDict(True) if isinstance(v, DataFrame) else v) for k, v in parts.items()}
    write_text(SparkSession.active(), path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


#: Most rows of a summary; it has one an experiment.
SUMMARY_ROWS = 100_000


def write_summary(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """A CSV file with a header and the columns in the order given, empty where a row or ``df`` lacks one; an old one is
    replaced whole. A summary has one row an experiment; more than ``SUMMARY_ROWS`` are refused."""
    columns = columns or tuple(df.columns)
    rows = df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).limit(SUMMARY_ROWS + 1).collect()
    if len(rows) > SUMMARY_ROWS:
        raise ValueError(f"a summary has at most {SUMMARY_ROWS} rows")
    out = StringIO()
    table = csv.writer(out, lineterminator="\n")
    table.writerow(columns)
    table.writerows(["" if v is None else v for v in r] for r in rows)
    write_text(df.sparkSession, path, out.getvalue())


def gpu_rows(text: Column) -> Column:
    """Array of struct(index, used, total) of the lines of three comma-separated numbers in a monitor's output."""
    cells = F.transform(F.split(text, r"\R"), lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c).try_cast("double")))
    good = F.filter(cells, lambda c: (F.size(c) == 3) & F.forall(c, lambda v: v.isNotNull()))
    return F.transform(good, lambda c: F.struct(c[0].cast("int").alias("index"), c[1].alias("used"), c[2].alias("total")))


def merge_shards(spark: SparkSession, paths: list[str], schema: str = LABEL) -> DataFrame:
    return spark.read.schema(schema).json(paths)
