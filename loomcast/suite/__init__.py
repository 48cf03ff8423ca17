"""Queries over the given tables, one or more per operator, with SQL twins."""

from __future__ import annotations


def load():
    """All registered queries by name."""
    from loomcast.suite import registry
    from loomcast.suite import indicator_queries, monitor_queries, run_queries, series_queries, state_queries, stream_queries  # noqa: F401

    return registry.REGISTRY
