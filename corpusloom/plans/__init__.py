"""Registered queries of the core."""

from __future__ import annotations


def all_core():
    """The core registry with every core query module loaded."""
    from corpusloom.plans import analysis_queries, exchange_queries, hierarchy_queries, library_queries, text_queries  # noqa: F401
    from corpusloom.plans.registry import core

    return core
