"""The registered queries of this subpackage and their SQL."""

from . import decontaminate, language_id, licenses, line_dedup, lm_score, merkle, near_dedup, packing, periodic_runs, quality, secrets, span_dedup, token_store

MODULES = [licenses, token_store, line_dedup, decontaminate, span_dedup, near_dedup, packing, secrets, lm_score, quality, language_id, periodic_runs, merkle]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
