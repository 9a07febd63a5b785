"""Names of the text queries; ``__spark_entry__`` adds them where this subpackage is there."""

from __future__ import annotations

from panelcast.llm import chat, decontaminate, divergence, language, lines, neardup, packing, quality, resample, secrets, sharding, substrings, toxicity

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat_format": chat.op9_chat_format,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_source_audit": divergence.op11_source_audit,
    "op12_language_id": language.op12_language_id,
    "op13_resample": resample.op13_resample,
}
ORACLES = {
    "op3_line_dedup": lines.OP3_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_source_audit": divergence.OP11_SQL,
    "op13_resample": resample.OP13_SQL,
}
