"""Importing this package registers every named query."""

from tidegrid.plans import features, flagship, forecasts, instances, joins, models, reshape, scores, sources, windows  # noqa: F401
from tidegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
