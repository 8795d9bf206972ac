"""Sidecar documents: for each role one document an id, replaced by later ones, pruned with their manifest, and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import raw_preview
from tessera.scratch import freed_shuffles
from tessera.sources.versions import Versions


def scan(spark: SparkSession, root: str, role: str, schema: str) -> DataFrame:
    """Documents ``json/<role>/*.json`` of other writers, a file each, but the report; with name, that of the file."""
    df = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/json/{role}/*.json")
    name = F.col("_metadata.file_name")
    return df.withColumn("name", name).filter(F.col("name") != "parse_report.json")


def report(docs: DataFrame) -> DataFrame:
    """One row: documents, parsed and failed ones, elements of the parsed ones."""
    ok = F.coalesce("parse_ok", F.lit(False))
    return docs.agg(F.count("*").alias("total_files"), F.count_if(ok).alias("parse_ok"), F.count_if(~ok).alias("parse_failed"), F.coalesce(F.sum(F.when(ok, F.col("element_count"))), F.lit(0)).alias("total_elements"))


def failures(docs: DataFrame) -> DataFrame:
    """(id, parse_error, preview) of the documents that were not parsed; without an id, the name of the file is one."""
    own = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.regexp_replace("name", r"\.json$", "")) if "name" in docs.columns else F.col("id").cast("string")
    return docs.filter(~F.coalesce("parse_ok", F.lit(False))).select(own.alias("id"), "parse_error", raw_preview(F.col("raw_model_output")).alias("preview"))


class Sidecars:
    """A store of documents (role, id, ...) as JSON lines by role, compressed by gzip. Each write is a version of three tables, documents,
    report and failures, which appear together or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def documents(self, role: str | None = None) -> DataFrame:
        df = self.versions.read("documents")
        return df if role is None else df.filter(F.col("role") == role)

    def report(self) -> DataFrame:
        """A row a role: role, total_files, parse_ok, parse_failed, total_elements."""
        return self.versions.read("report")

    def failures(self) -> DataFrame:
        return self.versions.read("failures")

    def write(self, docs: DataFrame, manifest: DataFrame | None = None) -> dict:
        """Adds documents; one of a known role and id replaces the old one, and of equal ones any stays.

        With a manifest (id), documents of the written roles whose id it lacks are pruned, old and new; other roles stay
        as they are. Both are joins by id, so nothing but the changed set decides the result, and a rerun gives the same.

        Documents are shuffled only where a decision needs it: for repeated ones if there are any, and once by id against
        what changes. They are written once, and report and failures are made from the files.
        """
        with freed_shuffles(self.versions.spark):
            # a row a role, of which there are few: roles are folders
            written_roles = docs.groupBy("role", "id").count().groupBy("role").agg(F.max("count").alias("most")).collect()
            roles = [r.role for r in written_roles if r.role is not None]
            new = docs.dropDuplicates(["role", "id"]) if any(r.most > 1 for r in written_roles) else docs
            known = None if manifest is None else manifest.select("id").distinct()
            if known is not None:
                new = new.join(known, "id", "left_semi")
            if self.versions.current():
                changed = docs.select("id", "role", F.lit(False).alias("__known"))
                if known is not None:
                    changed = changed.unionByName(known.select("id", F.lit(None).cast("string").alias("role"), F.lit(True).alias("__known")))
                changed = changed.groupBy("id").agg(F.collect_set("role").alias("__replaced"), F.max("__known").alias("__known"))
                old = self.documents().join(changed, "id", "left").filter(~F.coalesce(F.array_contains("__replaced", F.col("role")), F.lit(False)))
                if known is not None:
                    old = old.filter(~F.coalesce(F.col("role").isin(roles), F.lit(False)) | F.coalesce("__known", F.lit(False)))
                new = new.unionByName(old.drop("__replaced", "__known"), allowMissingColumns=True)
            return self.versions.write({"documents": new.select(*[c for c in new.columns if c != "role"], "role")}, fmt="json", partition_by={"documents": ["role"]},
                                       derived={"report": lambda made: self._by_role(made["documents"]), "failures": lambda made: self._failed(made["documents"])}, compression="gzip")

    @staticmethod
    def _by_role(docs: DataFrame) -> DataFrame:
        ok = F.coalesce("parse_ok", F.lit(False))
        return docs.groupBy("role").agg(F.count("*").alias("total_files"), F.count_if(ok).alias("parse_ok"), F.count_if(~ok).alias("parse_failed"),
                                        F.coalesce(F.sum(F.when(ok, F.col("element_count").cast("long"))), F.lit(0)).alias("total_elements"))

    @staticmethod
    def _failed(docs: DataFrame) -> DataFrame:
        failed = docs.filter(~F.coalesce("parse_ok", F.lit(False)))
        return failed.select("role", F.col("id").cast("string").alias("id"), "parse_error", raw_preview(F.col("raw_model_output")).alias("preview"))
