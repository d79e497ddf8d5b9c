"""Registered queries (one per operator of the inventory) and their SQL oracles."""

from __future__ import annotations

_MODULES = ["q_sources", "q_tokens", "q_correct", "q_ngram", "q_metrics", "q_match", "q_mine", "q_stats", "q_io"]


def all_queries():
    """Import every query module once; return (QUERIES, ORACLES)."""
    import importlib

    from logweave.plans.registry import ORACLES, QUERIES

    for m in _MODULES:
        importlib.import_module(f"logweave.plans.{m}")
    return QUERIES, ORACLES


all_queries.FLAGSHIP = "ngram_event_table"
