"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from colocus.llm import html_main, jaccard_join, lm_trie, mixing, packing, quality_rules, simhash, spot_signatures, suffix_dedup, token_files, warc, whitening

QUERIES = {
    "op1_lm_trie": lm_trie.op1_lm_trie,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_files": token_files.op3_token_files,
    "op4_spot_signatures": spot_signatures.op4_spot_signatures,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_main": html_main.op8_html_main,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_simhash": simhash.op11_simhash,
    "op12_whitening": whitening.op12_whitening,
}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.op2_sql(), "op6_jaccard_join": jaccard_join.op6_sql()}
