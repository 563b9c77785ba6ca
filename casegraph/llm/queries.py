"""The registered corpus queries and their SQL, by name."""

from __future__ import annotations

from casegraph.llm import chat, decontaminate, fingerprint, language, line_dedup, mixing, near_dedup, quality, resample, substring_dedup, topk, url_filter, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_language": language.op6_language,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_topk": topk.op11_topk,
    "op12_whitening": whitening.op12_whitening,
    "op13_resampling": resample.op13_resampling,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_url_filters": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op11_topk": topk.ORACLE,
    "op13_resampling": resample.ORACLE,
}
