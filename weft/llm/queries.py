"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from weft.llm import chat, code_compression, decontaminate, language_model, licenses, mixing, near_dup, posting_lists, quality, spelling, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_quality_rules": quality.query,
    "op3_suffix_array_dedup": suffix_dedup.query,
    "op4_lm_scoring": language_model.query,
    "op5_chat_formatting": chat.query,
    "op6_toxicity": toxicity.query,
    "op7_minhash_near_dedup": near_dup.query,
    "op8_license_scans": licenses.query,
    "op9_source_mixing": mixing.query,
    "op10_url_filters": url_filter.query,
    "op11_vector_code_compression": code_compression.query,
    "op12_spelling_variants": spelling.query,
    "op13_nearest_neighbours": posting_lists.query,
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_suffix_array_dedup": suffix_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op7_minhash_near_dedup": near_dup.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op10_url_filters": url_filter.oracle(),
    "op11_vector_code_compression": code_compression.oracle(),
}
