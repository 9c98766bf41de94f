"""The registered queries of this subpackage, and DuckDB's SQL for those it can express."""

from __future__ import annotations

from . import byte_bpe, html_extraction, mpeg_audio, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_packing": packing.op2_packing,
        "op3_quality_classifier": quality_classifier.op3_quality_classifier,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_html_extraction": html_extraction.op5_html_extraction,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_simhash": simhash.op7_simhash,
        "op8_pii": pii.op8_pii,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_mpeg_audio": mpeg_audio.op10_mpeg_audio,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.oracle()}
