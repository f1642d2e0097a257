"""Queries op2, op3 and op8."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import quality, suffix_tree, toxicity
from tidemark.llm.common import is_fold, table

TOXIC_AT = 0.7
GOOD_AT = 0.3


def toxicity_model(docs, labels):
    return toxicity.train(docs, labels, ~is_fold(F.col("doc_id"), 3, 1))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(spark, docs.select("doc_id", "text"), model).select(
        "doc_id", is_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "toxic_tokens", "spans")


def op3_suffix_tree_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = is_fold(F.col("doc_id"), 7, 2)
    return suffix_tree.score_documents(spark, docs, docs.where(~held_out)).withColumn(
        "held_out", held_out)


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~is_fold(F.col("doc_id"), 5, 0))
    return quality.score_documents(spark, docs.select("doc_id", "text"), model).select(
        "doc_id", is_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op2_toxicity, op3_suffix_tree_lm, op8_quality_classifier)}
ORACLE: dict[str, str] = {}
