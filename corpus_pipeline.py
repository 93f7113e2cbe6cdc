"""A corpus run from raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwise.llm import mixing, pieces, pii, quality, simhash
from pitwise.llm.common import documents, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds of their language and source keep, with all columns.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows
    are judged alike; an empty table gives none.
    """
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id: shingles of five words, similarity of 0.8 or more.

    Texts without words are alike; a null doc_id comes last, ties go by the text's hash; of repeated rows one stays; an
    empty table gives none.
    """
    return simhash.unique_documents(docs, size=5, similarity=0.8)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in angle brackets, with ``n_chars`` set anew; no document goes.

    Null texts stay null, texts without personal data stay as they are, repeated rows are kept, an empty table gives none.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words: none, one or several times.

    Null texts and texts without words go; a null source is a source; of repeated rows one stands for all; an empty
    table gives none.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces, spans and decoded text: a row for every row.

    A null text is empty and gives just the end id; null doc_ids are kept; an empty table gives none.
    """
    return pieces.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The stages train a model, sketch quantiles and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read back as the next one's input."""
    docs, at = documents(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
