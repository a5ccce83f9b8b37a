"""The operators' queries, and SQL twins where SQL can express them."""

from __future__ import annotations

from clinigrid.llm import (
    classifier, conversation_trie, decontamination, language, personal_data, pieces, quality, repeats, secret_scan, simhash, spelling,
    token_counts, toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_personal_data": personal_data.op3_personal_data,
    "op4_remove_repeats": repeats.op4_remove_repeats,
    "op5_simhash_near_duplicates": simhash.op5_simhash_near_duplicates,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_quality_classifier": classifier.op13_quality_classifier,
}
ORACLES = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op4_remove_repeats": repeats.OP4_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
}
