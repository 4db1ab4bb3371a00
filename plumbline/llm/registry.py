"""Queries of this package, and DuckDB SQL for those that SQL can express."""

from . import chat, decontamination, html_text, language_model, licenses, mixing, near_dedup, neighbours, substrings, toxicity

QUERIES = {
    "op1_lm_score": language_model.op1_lm_score,
    "op2_nearest": neighbours.op2_nearest,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_repeated_passages": substrings.op6_repeated_passages,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_html_extract": html_text.op10_html_extract,
}
SQL = {"op5_decontamination": decontamination.SQL, "op8_chat_format": chat.SQL, "op9_mix_sources": mixing.SQL}
