"""The corpus pipeline: documents to a cleaned, mixed corpus in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the next stage's documents. Other columns of
the documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import decontaminate, mixing, quality, secrets, simhash
from rentlens.llm.common import shielded, staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's record accept."""
    labels = table(spark, sf_dir, "labels")

    def accepted(plain: DataFrame) -> DataFrame:
        judged = quality.judged(plain, labels, host=F.col("source"), path=F.col("lang"))
        return judged.where("accepted").select(plain.columns)

    return shielded(docs, ["doc_id", "text", "lang", "source"], accepted)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    return simhash.one_of_each(docs, shingle=3, bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the number of copies that it takes.

    Columns named like those that the mix adds are replaced.
    """
    return mixing.balance(docs).where("copies > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_to_targets),
]

#: The first stage trains a classifier and the fourth a Markov model: SQL cannot say either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
