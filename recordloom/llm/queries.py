"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import decontam, exact_dedup, langid, line_dedup, lm, mixing, near_dup, planes, quality, token_counts

QUERIES = {
    "op1_ngram_jaccard_join": near_dup.op1_ngram_jaccard_join,
    "op2_token_planes": planes.op2_token_planes,
    "op3_suffix_tree": lm.op3_suffix_tree,
    "op4_importance_resampling": quality.op4_importance_resampling,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_fuzzy_lines": line_dedup.op7_fuzzy_lines,
    "op8_simhash_decontamination": decontam.op8_simhash_decontamination,
    "op9_language_id": langid.op9_language_id,
    "op10_soft_mixing": mixing.op10_soft_mixing,
}
ORACLES = {"op1_ngram_jaccard_join": near_dup.ORACLE_OP1, "op5_exact_dedup": exact_dedup.ORACLE_OP5}
