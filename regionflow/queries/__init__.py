"""Registered queries: every operator on the driver tables, most with an independent SQL check."""
from regionflow.queries import energy, geometry, models, network, registry, results  # noqa: F401
from regionflow.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
