"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import bpe, embedding_dup, exact_dedup, fill_in_middle, kneser_ney, near_dup, packing, quality, secrets, token_planes, toxicity, url_reputation, vector_codes

MODULES = [token_planes, packing, near_dup, toxicity, secrets, embedding_dup, bpe, quality, exact_dedup, kneser_ney, vector_codes, url_reputation, fill_in_middle]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
