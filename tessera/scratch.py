"""Scratch tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """That folder; where the setting is missing, one of our own in local mode and an error on a cluster, as no executor
    sees another's disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there, so lost executors cost no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    files, target = _at(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a whole folder, if there is one."""
    files, target = _at(spark, path)
    files.delete(target, True)


def files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files of a folder, by name."""
    store, target = _at(spark, folder)
    return sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(target) if f.isFile())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, in any store that Spark writes; it replaces an old one whole, or not at all."""
    store, target = _at(spark, path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    part = fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    context = fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(part), store.makeQualified(target), how)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or a folder within its store."""
    store, target = _at(spark, old)
    if not store.rename(target, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} cannot become {new}")


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind results of ``written`` that nothing reads any more."""
    for df in frames:
        path = df.__dict__.pop("_scratch_path", None)
        if path:
            delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, each write deletes the shuffle files that it made when it ends; else they stay until the driver happens to
    collect its garbage. For results that nothing computes again from the same plan."""
    old = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, old) if old is not None else spark.conf.unset(FREED)


def made_so_far() -> int:
    """A mark for ``drop_since``."""
    return len(_made)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Deletes the scratch tables made since the mark but those behind ``keep``."""
    kept = {df.__dict__.get("_scratch_path") for df in keep}
    for spark, path in _made[mark:]:
        if path not in kept:
            delete(spark, path)
    _made[mark:] = [x for x in _made[mark:] if x[1] in kept]


def drop_scratch() -> None:
    """Deletes the scratch tables made so far; only when no result that reads them is needed any more."""
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder with it
            return


atexit.register(drop_scratch)
