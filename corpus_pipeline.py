"""Corpus pipeline: language ID, toxicity, SimHash near-dedup, source mixing, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, langid, mixing, simhash, toxicity
from rankloom.llm.common import Scratch, free, held_out, pick, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: null texts and texts without a letter go.

    Repeated rows, ties and null ids stay; every column of ``docs`` keeps its values whatever its name; an empty table
    gives an empty one. Without any labelled row no language can be told, and every row goes.
    """
    model = langid.fit(pick(docs, "doc_id", "text", "lang").where(~held_out("doc_id", 3, 1)))
    lang, score = free(docs.columns, "lang_pred", "score")
    return langid.classify(docs, model, lang, score).where(F.col(lang) != langid.UNDETERMINED).drop(lang, score)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier of confirmed toxic examples and unlabelled text doesn't call toxic.

    Null and empty texts have the classifier's base score, and stay; so do repeated rows and null ids. Every column of
    ``docs`` keeps its values whatever its name; an empty table gives an empty one. Without toxic training rows all stay.
    """
    model = toxicity.fit(pick(docs, "doc_id", "text").where(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    score, predicted = free(docs.columns, "score", "predicted")
    return toxicity.score(docs, model, score, predicted).where(F.col(predicted) == 0).drop(score, predicted)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest doc_id.

    Null, empty and white-space texts are one group. Ties, repeated rows and null ids: :func:`simhash.keep_first`. Every
    column keeps its values whatever its name; an empty table gives an empty one.
    """
    return simhash.keep_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: a row of a document's taken words for each pass over its source that takes any.

    Texts without words give no row; null sources are one source; repeated rows are documents of their own. text and
    n_chars follow the words taken, other columns keep their values; an empty table gives an empty one.
    """
    return mixing.Mix(docs, keep=True).documents()


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix, repeated rows and null ids included.

    A null text is empty; columns of ``docs`` with the result's names play no part; an empty table gives an empty one.
    """
    return bpe.encode_decode(docs)


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("SimHash near-dedup", simhash_dedup), ("mixing sources to target weights", source_mixing), ("BPE encoding and decoding", encoding)]

#: No SQL: the classifiers, the fingerprints and the tokenizer aren't expressible there; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
