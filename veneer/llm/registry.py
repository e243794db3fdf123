"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from veneer.llm import op1_toxicity, op10_lines, op11_collocations, op12_phrases, op13_spellings, op2_suffix_dedup, op3_decontaminate, op4_sharding, op5_preference, op6_language, op7_bpe, op8_jaccard, op9_quality

_OPERATORS = (op1_toxicity, op2_suffix_dedup, op3_decontaminate, op4_sharding, op5_preference, op6_language, op7_bpe, op8_jaccard, op9_quality, op10_lines, op11_collocations, op12_phrases, op13_spellings)

QUERIES = {k: f for m in _OPERATORS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _OPERATORS for k, s in m.ORACLES.items()}
