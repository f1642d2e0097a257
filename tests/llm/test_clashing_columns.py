"""Columns of the input that are named like the operators' own."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.bpe_codec import BpeVocabulary, decode_ids
from tidemark.llm.bpe_codec import encode_texts as encode_bpe
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.filter_audit import audit_filters
from tidemark.llm.importance import resample
from tidemark.llm.jaccard_join import keep_one, similar_documents
from tidemark.llm.line_dedup import drop_boilerplate
from tidemark.llm.queries_tokens import BPE_FILE
from tidemark.llm.secrets import find_secrets
import corpus_pipeline

NAMES = ("_key", "key", "_kept", "kept", "_copy", "copy", "_of", "of", "_id", "id", "_drop",
         "row", "_row", "doc", "places", "first", "h", "node", "score", "spans", "weight",
         "rank", "mask", "part", "_base", "hit")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, f"text number {n} of a few words that are here for the test", "en", f"s{n}", 1)
            for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c)
                            for c in NAMES])


def unchanged(df, but=()):
    rows = df.collect()
    assert rows
    for r in rows:
        for c in NAMES:
            if c not in but:
                assert r[c] == f"{c} {r.doc_id}", c


def test_filter_stages(spark, docs):
    bench = spark.createDataFrame([(0, "an item of the benchmark with enough words in it")],
                                  "item_id long, text string")
    for out in (drop_boilerplate(docs), keep_one(spark, docs),
                drop_contaminated(spark, docs, bench)):
        assert out.columns == docs.columns
        unchanged(out)


def test_toxicity_stage(spark, docs):
    out = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    unchanged(out)


def test_scores_replace_columns_of_their_name(spark, docs):
    rows = [("good text", 0), ("bad text", 1)] * 3
    out = toxicity.score_documents(spark, docs, toxicity.fit(rows))
    unchanged(out, but=("score", "spans"))
    assert dict(out.dtypes)["score"] == "double"
    out = quality.score_documents(spark, docs, quality.fit(rows))
    unchanged(out, but=("score",))


def test_operators_with_columns_of_their_own(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert similar_documents(spark, docs).count() == 6
    assert audit_filters(spark, docs, labels.withColumn("key", F.lit("x"))).count() == 600
    assert resample(spark, docs, docs).count() == 6
    unchanged(find_secrets(docs), but=("_base",))
    vocabulary = BpeVocabulary(BPE_FILE)
    unchanged(decode_ids(spark, encode_bpe(spark, docs, vocabulary), vocabulary))
