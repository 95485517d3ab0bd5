"""Where the queries and their independent SQL twins are collected."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "q_sources", "q_windows", "q_joins", "q_returns", "q_technical", "q_regression",
    "q_portfolio", "q_documents", "q_brief", "q_panel", "q_evaluation", "q_models",
    "q_postings", "q_feed", "q_streams", "q_matches", "q_profile",
)


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL twin when it has one."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")
