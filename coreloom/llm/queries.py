"""Queries op1_ to op10_ and their SQL."""

from __future__ import annotations

from coreloom.llm import ann, chat_format, exact_dedup, language_id, line_dedup, lm_scoring, minhash, mixing, packing, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_language_id": language_id.op7_language_id,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_chat_formatting": chat_format.op10_chat_formatting,
}

ORACLES = {
    "op4_mix_sources": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_chat_formatting": chat_format.SQL,
}
