"""Operators of a training-data pipeline. Nothing else in the package imports this one.

queries() and oracle_sql() collect what the modules register."""

from __future__ import annotations

from codeweft.llm import decontaminate, language_id, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, sharding, toxicity

MODULES = (mixing, lm_score, quality, toxicity, decontaminate, line_dedup, ngram_join, sharding, license_scan, language_id)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
