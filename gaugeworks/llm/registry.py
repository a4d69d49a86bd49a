"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, decontaminate, divergence, jaccard, order_minhash, quality, subspace_join, suffix_dedup, token_counts, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_bpe": bpe.op10_bpe,
    "op5_quality": quality.op5_quality,
    "op2_token_counts": token_counts.op2_token_counts,
    "op8_chat": chat.op8_chat,
    "op9_order_minhash": order_minhash.op9_order_minhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_jaccard": jaccard.op4_jaccard,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op1_token_files": token_files.op1_token_files,
    "op11_alignment": alignment.op11_alignment,
    "op12_embedding_dedup": subspace_join.op12_embedding_dedup,
    "op13_divergence": divergence.op13_divergence,
}

#: op8_chat has a column that depends on token counts; tests hold the others against SQL.
SQL: dict[str, str] = {
    "op4_jaccard": jaccard.OP4_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op12_embedding_dedup": subspace_join.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
