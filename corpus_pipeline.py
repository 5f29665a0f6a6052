"""The corpus pipeline: quality, exact copies, near copies, the mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, further ones
included, whatever they are called. Null texts count as empty texts in every stage, texts are whole
whatever their length, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, minhash, mixing, pieces, quality
from ledgerloom.llm.common import shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of this table, does not reject.

    Those with a score of 0.3 or more stay. Equal texts get equal scores, so repeated rows stay or go together. Texts
    without terms score the share of label 1 among the labelled rows; with no labelled rows all score 0.5 and stay.
    Documents without an id have no label and are scored like others.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; of equal ones, that with the largest id.

    Texts are equal when identical after lower-casing A-Z. Null ids are the smallest; of rows that share text and id
    exactly one stays. Null and empty texts are one text.
    """
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of near copies.

    Documents without words and rows without an id are nobody's copies and stay. Rows that share an id are one
    document: all stay or all go.
    """
    return minhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: rows as often as it takes them, twice at most.

    Documents without words are taken as often as others of their source, none of a source without any words. Null sources are one source, the last in order. Ties are
    settled by a hash of the row, so reruns agree; of rows equal in every column each has its own place.
    """
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, source_bytes.

    Null and empty texts have no tokens. Repeated rows give repeated results, and null ids stay null. Other columns end here.
    """
    return pieces.digests(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("sentencepiece", pieces_stage)]

#: The classifier has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
