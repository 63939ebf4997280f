"""Queries of the inspection engine and their oracle SQL."""

from __future__ import annotations

from lotwise.functions import sql_functions
from lotwise.operators import clustering, correlation, genealogy, learning, listing, lots, pareto, quality_checks, run_sketches, spc, time_joins, yields
from lotwise.sources import klarf, klarf_source, tables
from lotwise.streaming import event_windows, online_spc

MODULES = [yields, sql_functions, run_sketches, pareto, quality_checks, lots, spc, correlation, genealogy, clustering, learning, listing, time_joins, klarf, klarf_source, tables, event_windows, online_spc]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
