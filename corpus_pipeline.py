"""A corpus pipeline: documents that are toxic go, one of each group of near copies stays, secrets are masked, sources
are mixed to target weights, and what remains is packed into bins.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import mixing, packing, secrets, simhash, toxicity
from graphweft.llm.common import drop_settled, settle, settle_only  # noqa: F401


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on those of them that are labelled, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest id."""
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by marks of their kind and n_chars counted anew."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' targets: a row a repetition, a fractional one cut to its words."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: which words of which document lie where. Repetitions of a document never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
#: Two stages have no counterpart in SQL (a trained model, XXH64 fingerprints).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents; what a stage returns is written to the shared folder and read again by the next.

    A stage's own tables and its input go once its result is written; those of the last stay, as its result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop_settled(before)
    return STAGES[-1][1](spark, docs, sf_dir)
