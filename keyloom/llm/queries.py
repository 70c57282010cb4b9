"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, licenses, mixing, pages, quality, sharding, simhash, suffixes, tokens

QUERIES = {
    "op1_bk_tree_simhash": simhash.op1_bk_tree_simhash,
    "op2_hash_tree": sharding.op2_hash_tree,
    "op3_raked_mix": mixing.op3_raked_mix,
    "op4_host_quality": quality.op4_host_quality,
    "op5_fused_language": langid.op5_fused_language,
    "op6_pretoken_counts": tokens.op6_pretoken_counts,
    "op7_merged_bwt": suffixes.op7_merged_bwt,
    "op8_layout_text": pages.op8_layout_text,
    "op9_license_windows": licenses.op9_license_windows,
    "op10_decontaminate": decontam.op10_decontaminate,
}

ORACLES = {
    "op3_raked_mix": mixing.ORACLE,
    "op4_host_quality": quality.ORACLE,
    "op7_merged_bwt": suffixes.ORACLE,
    "op10_decontaminate": decontam.ORACLE,
}
