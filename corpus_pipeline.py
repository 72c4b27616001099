"""A training corpus from documents: five stages, each one of the operators in interfacet.llm.

Rows are told apart by doc_id and text together, so rows without an id and different texts of one id
are each judged on their own. Null texts pass the filters as texts without words. An empty table gives
an empty one at every stage. Columns other than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interfacet.llm import decontaminate, minhash, packing, secrets, toxicity
from interfacet.llm.common import NO_ID, keyed, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (score below 0.7)."""
    auto, weights = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, auto, weights).select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more on five-word shingles: that of the smallest doc_id, then text hash.

    Repeated rows stay once. Texts without words and rows without doc_id are in no group.
    """
    found = minhash.groups(docs, width=5, percent=80)
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").alias("id"), "h")).alias("first")).select("first.*")
    alone = found.where("group is null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h")
    kept = materialize(first.unionByName(alone).distinct())
    return keyed(docs).join(kept, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("id", "h").distinct()
    return keyed(docs).join(bad, ["id", "h"], "left_anti").select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark; n_chars counts the new text where one was found."""
    return secrets.redact_rows(docs).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, cache=500_000)  # the workers of this stage live on beside those of others


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", packed_sequences),
]

#: The learned and iterative stages can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
