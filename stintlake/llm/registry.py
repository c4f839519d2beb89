"""Queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from stintlake.llm import byte_bpe, decontamination, dual_tree, hamming_search, license_scan, ngram_jaccard, packing, quality, rp_forest, sstable, toxicity, url_filter, yinyang

QUERIES = {
    "op1_hamming_search": hamming_search.op1_hamming_search,
    "op2_quality_ftrl": quality.op2_quality_ftrl,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_rp_forest": rp_forest.op4_rp_forest,
    "op5_sstable": sstable.op5_sstable,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_ngram_jaccard": ngram_jaccard.op8_ngram_jaccard,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_dual_tree_lloyd": dual_tree.op11_dual_tree_lloyd,
    "op12_yinyang_codes": yinyang.op12_yinyang_codes,
    "op13_decontamination": decontamination.op13_decontamination,
}
ORACLES = {
    "op1_hamming_search": hamming_search.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op11_dual_tree_lloyd": dual_tree.ORACLE,
    "op12_yinyang_codes": yinyang.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
