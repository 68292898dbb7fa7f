"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing and encoding, each on what the last kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casegrid.llm import jaccard, mixing, pieces, pii, quality
from casegrid.llm.common import materialize
from casegrid.llm.queries import PIECE_MODEL
from casegrid.shipping import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts are rejected; equal rows share their fate; null languages and sources are groups of their
    own; an empty table stays empty; other columns pass through under any names.
    """
    settle(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; sets of five-word shingles with a Jaccard
    similarity of 0.8 or more are linked.

    Texts without words all stay; of rows that repeat id and words one stays; null ids stay only where a group has no other;
    an empty table stays empty; other columns pass through under any names.
    """
    settle(spark)
    return jaccard.keep_one(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks.

    Rows are independent: null texts stay null and empty ones empty, repeated rows come out alike, an empty table stays
    empty; n_chars follows the text, and other columns pass through.
    """
    settle(spark)
    return pii.redact(docs, length_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come more than once, as temperature mixing has it; none is left out.

    Null sources are a source of their own; texts without words count no tokens and come once a pass; of equal rows as many
    come as the budget takes; an empty table stays empty; other columns pass through under any names.
    """
    settle(spark)
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the bytes of its text that each token covers.

    A null text counts as empty and has the end id only; repeated rows come out each; an empty table gives none.
    """
    settle(spark)
    return pieces.encode_texts(docs, ["doc_id", "lang", "source"], public_tokenizers.path(PIECE_MODEL))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("encode", encode)]
#: SQL has neither robust scatter nor SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
