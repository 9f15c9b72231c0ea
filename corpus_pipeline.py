"""Corpus preparation in stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; columns the table has
besides are carried along. Each stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm import neardup, quality, retrieval, secrets
from lexisearch.llm._spark import load, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a posterior probability of half or more stay.

    Null and empty texts go. Rows are judged one by one, so repeated rows fare alike.
    Texts may be of any length; an empty table stays empty.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Of rows that share an id, copies or not, the one with the least text stays (nulls
    last, then the least of what else they hold). Rows without an id, and texts that are
    null or without a word, are in no group; they stay. Texts may be of any length. An
    empty table stays empty.
    """
    mine = f"_{uuid4().hex}"  # no column of the table is named so
    found = neardup.groups(docs)
    gone = found.where("doc_id <> group_id").select(F.col("doc_id").alias(mine))
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(mine))
    lone = docs.join(gone, F.col("doc_id") == F.col(mine), "left_anti")
    again = lone.join(repeated, F.col("doc_id") == F.col(mine), "left_semi")
    # Rows of one id are reduced in parts, however many there are.
    row = F.struct(*(F.col(c) for c in docs.columns))
    order = F.struct(F.col("text").isNull(), F.col("text"), F.to_json(row))
    once = again.groupBy("doc_id").agg(F.min_by(row, order).alias(mine)).select(f"{mine}.*")
    return lone.join(repeated, F.col("doc_id") == F.col(mine), "left_anti").union(once)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced, and ``n_chars`` follows; every document stays.

    Null and empty texts stay as they are, and so does an empty table; texts and secrets
    may be of any length.
    """
    return secrets.redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 words, each filled with its first document's lexical neighbours.

    Null texts and texts without a word are in no window; repeated rows are packed each; longer
    texts are cut without loss; an empty table gives no windows.
    """
    return retrieval.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: Neither EM nor greedy packing can be said in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, with each result written and reread."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
