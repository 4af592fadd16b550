"""All registered queries, one module of them for each part of the library."""

from __future__ import annotations

from kinfold.plans import feed_queries, incoming_queries, maintenance_queries, relational_queries, resolve_queries, scalar_queries

MODULES = [scalar_queries, relational_queries, resolve_queries, maintenance_queries, feed_queries, incoming_queries]

QUERIES = {name: f for m in MODULES for name, f in m.Q.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.Q.oracles.items()}


def FLAGSHIP(spark, folder):  # noqa: N802
    """Pairs of series with all evidence and their score."""
    return QUERIES["e16_score_pairs"](spark, folder)
