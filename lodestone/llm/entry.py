"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, line_dedup, mixing, near_dedup, pii, quality, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.query,
        "op2_decontaminate": decontaminate.query,
        "op3_language_id": language_id.query,
        "op4_quality": quality.query,
        "op5_warc": warc.query,
        "op6_near_dedup": near_dedup.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_pii": pii.query,
        "op10_line_dedup": line_dedup.query,
        "lid_pages": language_id.pages_query,
    }


def oracle_sql() -> dict:
    return {
        "op2_decontaminate": decontaminate.SQL,
        "op5_warc": warc.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op10_line_dedup": line_dedup.SQL,
    }
