"""Queries of the operators in this folder, and their SQL twins where SQL can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.fingerprints import op9_fingerprints
from matchloom.llm.jaccard import OP8_SQL, op8_ngram_jaccard
from matchloom.llm.language_model import op2_lm_score
from matchloom.llm.media import op7_media_gif
from matchloom.llm.mixing import op10_mixing
from matchloom.llm.packing import op5_packing
from matchloom.llm.quality import op3_quality
from matchloom.llm.sharding import op6_sharding
from matchloom.llm.substring_dedup import op1_substring_dedup
from matchloom.llm.token_store import op4_token_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_lm_score": op2_lm_score,
        "op3_quality": op3_quality,
        "op4_token_ids": op4_token_ids,
        "op5_packing": op5_packing,
        "op6_sharding": op6_sharding,
        "op7_media_gif": op7_media_gif,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_fingerprints": op9_fingerprints,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """SQL has no model, tokenizer, codec or seeded draw; of the ten it can state the join."""
    return {"op8_ngram_jaccard": OP8_SQL}
