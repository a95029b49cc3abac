"""All queries of the core, with their SQL."""

from __future__ import annotations

from strataline.plans import data_queries, extraction, git, risk, search, structure, surfaces, symbols

MODULES = (data_queries, git, risk, symbols, structure, search, surfaces, extraction)
FLAGSHIP = "risk_hotspots_top"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
