"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.llm import (
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    vector_codes,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_secret_scan": secret_scan.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_language_id": language_id.op6,
    "op7_packing": packing.op7,
    "op8_html_extract": html_extract.op8,
    "op9_sentencepiece": sentencepiece_codec.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_quality_classifier": quality_classifier.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_vector_codes": vector_codes.op13,
}

SQL = {"op5_quality_rules": quality_rules.OP5_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
