"""Registered queries of the training-data operators, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import (
    decontaminate,
    filteraudit,
    hardnegatives,
    html,
    licences,
    lm,
    mixing,
    quality,
    secrets,
    shards,
    simhash,
    tokencount,
    vafile,
)
from rentlens.llm.common import table
from rentlens.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLES", "QUERIES"]


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)


@query
def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.balance(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        host=F.col("source"),
        path=F.col("lang"),
    )
    return found.select("doc_id", "evidence", "site_mean", "quality_prob", "accepted")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_sections(table(spark, sf_dir, "documents"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
    return hardnegatives.mine(rows.withColumn("label", F.when(F.col("label").isNotNull(), F.coalesce(moved, "label"))))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"))
