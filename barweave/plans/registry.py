"""Every registered query of the factor engine, with its SQL."""

from __future__ import annotations

from . import bar_queries, desk_queries, factor_queries, mining_queries, research_queries, upkeep_queries

_MODULES = (factor_queries, research_queries, bar_queries, desk_queries, upkeep_queries, mining_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = factor_queries.QUERIES["filled_mean_events"]
