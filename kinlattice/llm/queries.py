"""The opN queries and, where SQL can state a result, their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, language_id, licenses, line_dedup, near_dedup, pii, quality, toxicity, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_language_id": language_id.op8_language_id,
    "op9_licenses": licenses.op9_licenses,
    "op10_pii": pii.op10_pii,
}
ORACLES = {
    "op3_decontaminate": decontaminate.SQL,
    "op5_quality": quality.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_url_filter": url_filter.sql(),
    "op9_licenses": licenses.sql(),
}
