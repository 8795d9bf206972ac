"""Sets of tables that change together: a version is written beside the others, then one log entry makes it current."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.scratch import delete, exists


class Versions:
    """Versioned tables below a folder of any store that Spark writes.

    A writer that stops anywhere leaves the current version as it was: a version counts from its log entry on, a file of
    one line that appears whole. One writer at a time; any number of readers. The log has a line a version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> list[dict]:
        """Entries (number, version, tables, before) in order; ``before`` is the number that was current."""
        path = f"{self.root}/_log"
        if not exists(self.spark, path):
            return []
        return sorted((json.loads(r.value) for r in self.spark.read.text(path).collect()), key=lambda e: e["number"])

    def current(self) -> dict | None:
        entries = self.log()
        return entries[-1] if entries else None

    def _append(self, **entry) -> dict:
        line = self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1)
        line.write.mode("append").text(f"{self.root}/_log")
        return entry

    def write(self, tables: dict[str, DataFrame], version: str | None = None, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None,
              derived: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None, compression: str | None = None) -> dict:
        """Writes the tables and makes them current; a table may be derived from the version that it replaces, and the
        ``derived`` ones are made from the tables of this version as they are read back."""
        now = self.current()
        number = now["number"] + 1 if now else 1
        version = version or f"{number:06d}-{uuid.uuid4().hex[:8]}"
        schemas, made = {}, {}
        for name, df in [*tables.items(), *(derived or {}).items()]:
            df = df if name in tables else df(made)
            out = df.write.format(fmt).option("ignoreNullFields", "false").partitionBy(*(partition_by or {}).get(name, []))
            (out.option("compression", compression) if compression else out).save(f"{self.root}/{version}/{name}")
            schemas[name] = df.schema.jsonValue()
            made[name] = self.spark.read.format(fmt).schema(df.schema).load(f"{self.root}/{version}/{name}")
        return self._append(number=number, version=version, format=fmt, tables=schemas, before=now["number"] if now else None)

    def rollback(self) -> dict:
        """Makes the version before the current one current again; its tables were kept."""
        entries = {e["number"]: e for e in self.log()}
        now = entries[max(entries)] if entries else None
        if not now or now["before"] is None:
            raise ValueError("no version to go back to")
        old = entries[now["before"]]
        if not exists(self.spark, f"{self.root}/{old['version']}"):
            raise ValueError(f"version {old['version']} was cleaned away")
        return self._append(**old | {"number": now["number"] + 1})

    def read(self, name: str, entry: dict | None = None) -> DataFrame:
        at = entry or self.current()
        if not at or name not in at["tables"]:
            raise ValueError(f"no table {name} in {self.root}")
        return self.spark.read.format(at["format"]).schema(StructType.fromJson(at["tables"][name])).load(f"{self.root}/{at['version']}/{name}")

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes the versions that the current one and its ``keep`` - 1 predecessors do not use; for times without readers of those."""
        entries = {e["number"]: e for e in self.log()}
        at, used = entries.get(max(entries, default=0)), []
        while at and len(used) < max(1, keep):
            used.append(at["version"])
            at = entries.get(at["before"])
        gone = sorted({e["version"] for e in entries.values()} - set(used))
        for version in gone:
            delete(self.spark, f"{self.root}/{version}")
        return gone
