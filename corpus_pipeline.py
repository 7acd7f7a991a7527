"""A training corpus from raw documents, stage by stage.

language: documents without a recognisable language go. near_duplicates: one document of each group stays.
decontaminate: documents that hold benchmark passages beyond the coverage limit go. secrets: secrets are masked in
place. packing: what is left becomes pieces placed in sequences.

Every stage reads its predecessor's rows from a written table, so a lost executor costs one stage at most.

Null and empty texts have no language and go with the first stage. Rows without an id stay as they are in the second, which takes rows that share
an id for documents of their own where their texts differ, and for one where they repeat it; of equal texts the smallest id stays. Very
long texts are read whole; only packing cuts them. An empty table gives an empty result. Further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import decontaminate as tests, language as languages, near_text, packing as packs, secrets as keys
from ledgerlens.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised, unambiguous language; learned from those not held out."""
    model = languages.train(docs.where(~languages.held_out()).select("text", "lang"))
    found = languages.identify(docs, model)
    return found.where((F.col("lang_pred") != languages.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the smallest id's; see the operator for rows that share an id."""
    return near_text.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth or more."""
    found = tests.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; the number of characters follows."""
    _, found = keys.scan(docs)
    masked = keys.redact(found)
    chars = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    return packs.pack_documents(docs)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing),
]

#: Language, Bayesian and tokenizer stages are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
