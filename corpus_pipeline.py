"""Corpus pipeline over documents: reject toxic texts, keep one of each near-duplicate group, redact personal data, mix
the sources to their target weights, encode.

Every stage takes (spark, docs, directory of the tables) and works on all rows its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm import bpe, jaccard, mixing, pii, toxicity
from tessera.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled ones among them, does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id; a repeated row once."""
    return jaccard.deduplicated(docs, repeats=False)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.copies(mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the text decoded from them."""
    return bpe.encoded(docs, *bpe.public_vocabulary(), ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, mark = docs, scratch.made_so_far()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop_since(mark, docs)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
