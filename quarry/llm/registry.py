"""The queries of this subpackage and their SQL."""

from quarry.llm import (
    classifier,
    decontamination,
    fill_in_middle,
    html_extraction,
    jaccard_join,
    piece_encoding,
    prefix_trie,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filters,
)

QUERIES = {
    "op1_quality_classifier": classifier.op1_quality_classifier,
    "op2_sentencepiece": piece_encoding.op2_sentencepiece,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_jaccard_join": jaccard_join.op12_jaccard_join,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLES = {
    "op4_url_filters": url_filters.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
