"""Queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kontra.llm import chat, embedding_dedup, merkle, ngram_join, vector_codes
from kontra.llm.decontaminate import op9_query
from kontra.llm.language_model import op8_query
from kontra.llm.line_dedup import op4_query
from kontra.llm.mixing import op7_query
from kontra.llm.packing import op13_query
from kontra.llm.quality import op6_query
from kontra.llm.tokens import op2_query
from kontra.llm.toxicity import op10_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embedding_dedup.op1_query,
        "op2_token_counts": op2_query,
        "op3_chat_formatting": chat.op3_query,
        "op4_line_dedup": op4_query,
        "op5_ngram_jaccard_join": ngram_join.op5_query,
        "op6_quality_classifier": op6_query,
        "op7_source_mixing": op7_query,
        "op8_lm_scoring": op8_query,
        "op9_benchmark_decontamination": op9_query,
        "op10_toxicity": op10_query,
        "op11_vector_codes": vector_codes.op11_query,
        "op12_merkle_manifest": merkle.op12_query,
        "op13_packing": op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": embedding_dedup.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op5_ngram_jaccard_join": ngram_join.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE,
    }
