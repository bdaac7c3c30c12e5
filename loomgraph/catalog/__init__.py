"""Registered queries with, where SQL can say it, the equivalent SQL."""

from loomgraph.catalog.base import ORACLES, QUERIES


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"loomgraph.catalog.{name}")


MODULES = [
    "filters",
    "aggregation",
    "cleaning",
    "search",
    "resolution",
    "evaluation",
    "rewards",
    "rollouts",
    "datasets",
    "streams",
    "sinks",
    "ranking",
    "neighbours",
    "graph",
]

__all__ = ["ORACLES", "QUERIES", "load"]
