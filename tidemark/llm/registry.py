"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import byte_bpe, exact_dedup, jaccard_join, lm_scoring, packing, quality_rules, quotations, token_counts, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_warc": warc.op2_warc,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quotation_linking": quotations.op9_quotation_linking,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
}

ORACLE_SQL = {
    "op2_warc": warc.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_quotation_linking": quotations.SQL,
    "op10_ngram_jaccard_join": jaccard_join.SQL,
}
