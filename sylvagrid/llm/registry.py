"""Queries of this subpackage and their SQL checks; `__spark_entry__` adds them to the others."""

from __future__ import annotations

from sylvagrid.llm import (
    alignment,
    classifier,
    decontaminate,
    filter_audit,
    fixity,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixture,
    quality_rules,
    suffix_dedup,
    url_filter,
)

# queries without SQL are tested against brute force in tests/llm
_QUERIES = {
    "op1_license_scan": (license_scan.op1_license_scan, None),
    "op2_quality_rules": (quality_rules.op2_quality_rules, None),
    "op3_quality_classifier": (classifier.op3_quality_classifier, None),
    "op4_jaccard_join": (jaccard_join.op4_jaccard_join, None),
    "op5_line_dedup": (line_dedup.op5_line_dedup, line_dedup.OP5_SQL),
    "op6_suffix_dedup": (suffix_dedup.op6_suffix_dedup, None),
    "op7_decontamination": (decontaminate.op7_decontamination, decontaminate.OP7_SQL),
    "op8_mixture": (mixture.op8_mixture, mixture.OP8_SQL),
    "op9_url_filter": (url_filter.op9_url_filter, url_filter.OP9_SQL),
    "op10_fixity": (fixity.op10_fixity, fixity.OP10_SQL),
    "op11_token_alignment": (alignment.op11_token_alignment, None),
    "op12_filter_audit": (filter_audit.op12_filter_audit, filter_audit.OP12_SQL),
    "op13_language_id": (language_id.op13_language_id, None),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
