"""Queries of the training-data operators, and their SQL where SQL can express them."""

from mnemospark.llm import (
    brown_lm,
    decontamination,
    html_extraction,
    language_id,
    licenses,
    mixing,
    near_dedup,
    quality_rules,
    substrings,
    toxicity,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_language_id": language_id.op5_language_id,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_brown_lm": brown_lm.op8_brown_lm,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLES = {
    "op6_near_dedup": near_dedup.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op3_decontaminate": decontamination.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op10_license_scan": licenses.SQL,
}
