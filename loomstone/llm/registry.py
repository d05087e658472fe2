"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loomstone.llm import chat, classifier, decontaminate, nearest, neardup, repeats, rules, secrets, sentencepieces, sharding, spelling, structure, tokens

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_repeats": repeats.op6_repeats,
    "op7_quality_classifier": classifier.op7_quality_classifier,
    "op8_chat_format": chat.op8_chat_format,
    "op9_secrets": secrets.op9_secrets,
    "op10_sharding": sharding.op10_sharding,
    "op11_structure_repair": structure.op11_structure_repair,
    "op12_exact_top_k": nearest.op12_exact_top_k,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op4_decontaminate": decontaminate.ORACLE, "op8_chat_format": chat.ORACLE, "op11_structure_repair": structure.ORACLE, "op12_exact_top_k": nearest.ORACLE, "op13_spelling_variants": spelling.ORACLE}
