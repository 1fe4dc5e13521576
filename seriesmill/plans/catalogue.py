"""Collects the query modules of this package."""

from __future__ import annotations

from seriesmill.plans import q_compat, q_detect, q_evaluate, q_events, q_more, q_report, q_select, q_synth

MODULES = [q_events, q_evaluate, q_compat, q_detect, q_report, q_synth, q_more, q_select]


def queries() -> dict:
    """All queries of the modules, by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """All oracle texts of the modules, by name."""
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
