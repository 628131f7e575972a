"""All named queries over the bound tables, and their DuckDB equivalents."""

from __future__ import annotations

from . import board_queries, distribution_queries, inference_queries, module_queries, relational_queries, source_queries, study_queries, text_queries

_MODULES = (distribution_queries, relational_queries, text_queries, source_queries, study_queries, board_queries, module_queries, inference_queries)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
