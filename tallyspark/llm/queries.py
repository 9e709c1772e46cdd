"""The registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, divergence, html_text, lm_scoring, mixing, mpeg_audio, near_dup, packing, pii, quality, token_counts, vector_codes
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda spark, d: mixing.op1_mixing(read(spark, d, "documents")),
    "op2_html_text": lambda spark, d: html_text.op2_html_text(read(spark, d, "pages")),
    "op3_media": lambda spark, d: mpeg_audio.op3_media(read(spark, d, "documents")),
    "op4_pii": lambda spark, d: pii.op4_pii(read(spark, d, "documents")),
    "op5_lm_scoring": lambda spark, d: lm_scoring.op5_lm_scoring(read(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op6_token_counts": lambda spark, d: token_counts.op6_token_counts(read(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op7_quality": lambda spark, d: quality.op7_quality(read(spark, d, "documents"), read(spark, d, "labels")),
    "op8_chat_format": lambda spark, d: chat_format.op8_chat_format(read(spark, d, "conversations")),
    "op9_decontamination": lambda spark, d: decontamination.op9_decontamination(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op10_near_dup": lambda spark, d: near_dup.op10_near_dup(read(spark, d, "documents")),
    "op11_packing": lambda spark, d: packing.op11_packing(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op12_divergence": lambda spark, d: divergence.op12_divergence(read(spark, d, "documents")),
    "op13_vector_codes": lambda spark, d: vector_codes.op13_vector_codes(spark, read(spark, d, "embeddings")),
}

ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op8_chat_format": chat_format.ORACLE, "op12_divergence": divergence.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
