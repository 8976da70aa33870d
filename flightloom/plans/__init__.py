"""Queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("validation_queries", "feature_queries", "decision_queries", "retrieval_queries", "record_queries", "report_queries", "review_queries", "signal_queries")


def all_queries():
    """Registered queries and their SQL, by name."""
    for name in MODULES:
        importlib.import_module(f"flightloom.plans.{name}")
    from flightloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
