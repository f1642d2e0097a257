"""Queries op6 and op12."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import bpe_codec
from tidemark.llm.common import table
from tidemark.llm.sentencepiece_codec import Vocabulary, round_trip

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BPE_FILE = "/opt/tokenizers/word_bpe_49k.json"


def encoded_documents(spark, docs, model_file: str = MODEL_FILE):
    """doc_id, ids, n_tokens and whether the ids decode to the text again."""
    vocabulary = Vocabulary(model_file)
    return round_trip(spark, docs.select("doc_id", "text"), vocabulary).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op6_sentencepiece_codec(spark, sf_dir):
    return encoded_documents(spark, table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark, sf_dir, file: str = BPE_FILE):
    vocabulary = bpe_codec.BpeVocabulary(file)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.round_trip(spark, docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op6_sentencepiece_codec, op12_bpe_codec)}
ORACLE: dict[str, str] = {}
