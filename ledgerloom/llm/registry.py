"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerloom.llm import embeddings, exact_dedup, minhash, mixing, pieces, pii, quality, sharding, substrings, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_minhash": minhash.op2_minhash,
        "op3_mixing": mixing.op3_mixing,
        "op4_pii": pii.op4_pii,
        "op5_quality": quality.op5_quality,
        "op6_sharding": sharding.op6_sharding,
        "op7_substrings": substrings.op7_substrings,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": embeddings.ORACLE,
        "op2_minhash": minhash.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
