"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import brown_lm, crf, decontaminate, jaccard, media, mixing, ordinal, preferences, suffix_dedup, token_files

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_partenum_jaccard": jaccard.op2_partenum_jaccard,
    "op3_crf_quality": crf.op3_crf_quality,
    "op4_brown_lm": brown_lm.op4_brown_lm,
    "op5_avi_media": media.op5_avi_media,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_preference_pairs": preferences.op7_preference_pairs,
    "op8_pivotal_mix": mixing.op8_pivotal_mix,
    "op9_ordinal_toxicity": ordinal.op9_ordinal_toxicity,
    "op10_token_files": token_files.op10_token_files,
}

ORACLE_SQL = {
    "op2_partenum_jaccard": jaccard.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op7_preference_pairs": preferences.ORACLE_SQL,
}
