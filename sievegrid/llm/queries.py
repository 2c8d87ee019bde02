"""Queries of the training-data operators, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_embedding_neardup": "op01_embedding_neardup",
    "op2_ngram_jaccard_join": "op02_ngram_join",
    "op3_line_dedup": "op03_line_dedup",
    "op4_bpe_roundtrip": "op04_bpe",
    "op5_pii_bootstrap": "op05_pii",
    "op6_toxicity": "op06_toxicity",
    "op7_best_fit_packing": "op07_packing",
    "op8_token_counts": "op08_token_counts",
    "op9_chat_format": "op09_chat",
    "op10_additive_ann": "op10_ann",
    "op11_filter_audit": "op11_filter_audit",
    "op12_hard_negatives": "op12_hard_negatives",
    "op13_lempel_ziv": "op13_lempel_ziv",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import op01_embedding_neardup, op02_ngram_join, op03_line_dedup, op09_chat, op11_filter_audit, op12_hard_negatives

    return {
        "op1_embedding_neardup": op01_embedding_neardup.SQL,
        "op2_ngram_jaccard_join": op02_ngram_join.SQL,
        "op3_line_dedup": op03_line_dedup.SQL,
        "op9_chat_format": op09_chat.SQL,
        "op11_filter_audit": op11_filter_audit.SQL,
        "op12_hard_negatives": op12_hard_negatives.SQL,
    }
