"""Operators that prepare training text: one module each, with its query and its SQL."""

from __future__ import annotations

from thicket.llm import (
    best_fit_packing,
    chat_format,
    exact_dedup,
    language_id,
    lm_scoring,
    minhash_dedup,
    mixing,
    sketches,
    toxicity,
    url_filter,
)

MODULES = (
    mixing, lm_scoring, best_fit_packing, url_filter, language_id,
    chat_format, minhash_dedup, sketches, toxicity, exact_dedup,
)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
