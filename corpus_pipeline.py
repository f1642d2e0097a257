"""A training corpus out of raw documents, stage by stage.

Every stage takes the documents its predecessor kept, is written as Parquet
and read again as the next one's input.  All stages but the last return the
columns of the documents.  Tables and column types are those of `documents`;
nulls, empty texts, repeated rows and extra columns follow the rules stated by
the operator of each stage, and an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import materialize, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.line_dedup import drop_boilerplate
from tidemark.llm.queries_models import TOXIC_AT, toxicity_model
from tidemark.llm.queries_tokens import encoded_documents


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity score rejects go; learned from the given tables."""
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = docs.columns
    scored = toxicity.score_documents(
        spark, docs.select(F.col("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")),
        model)
    return scored.where(F.col("score") < TOXIC_AT).select(
        *[F.col("_row").getField(n).alias(n) for n in names])


def dedup_lines(spark, docs, sf_dir):
    """Cross-site boilerplate lines go, but for one copy."""
    return drop_boilerplate(docs)


def join_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return keep_one(spark, docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Piece ids of what is left, checked by decoding."""
    return encoded_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

# The score of a trained model has no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
