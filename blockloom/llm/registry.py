"""All registered corpus queries and their SQL."""

from __future__ import annotations

from blockloom.llm import op1_simhash, op2_packing, op3_token_counts, op4_toxicity, op5_quality, op6_topk, op7_suffix_dedup, op8_tiff, op9_url_filter, op10_sentencepiece

MODULES = (op1_simhash, op2_packing, op3_token_counts, op4_toxicity, op5_quality, op6_topk, op7_suffix_dedup, op8_tiff, op9_url_filter, op10_sentencepiece)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
