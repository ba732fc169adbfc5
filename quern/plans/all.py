"""All registered queries."""

from quern.plans import audit, experiments, metrics, rasters, reports, sources, streams  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
