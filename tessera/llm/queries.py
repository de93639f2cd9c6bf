"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard_join, language_id, mixing, neighbours, packing, quality_rules, secrets, substring_dedup, token_counts, toxicity

MODULES = (neighbours, language_id, substring_dedup, mixing, packing, token_counts, quality_rules, toxicity, jaccard_join, secrets)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
