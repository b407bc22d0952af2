"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import languages
from flowsieve.llm.leaks import without_leaks
from flowsieve.llm.near_copies import near_copy_clusters
from flowsieve.llm.packing import pack
from flowsieve.llm.secrets import mask_secrets
from flowsieve.llm.simhash import one_of_each
from flowsieve.session import materialise, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, ``lang`` their predicted language. Learned from the training fold of the documents.

    If that has no label, no language can be told: labels stay as they are.
    """
    model = languages.train(docs.filter(~languages.held_out(F.col("doc_id"))))
    return languages.keep_identified(docs, model) if model.languages else languages.keep_letters(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the one with the smallest id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return mask_secrets(docs, scratch_path(spark, "pipeline-ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the bins; near copies that are left do not share one."""
    documents = near_copy_clusters(docs)
    return pack(documents, cluster=documents["cluster"], length=documents["n"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL has no SimHash, mixture inference or best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
