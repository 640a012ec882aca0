"""All registered queries."""

from textguard.plans import monitoring, scanning, scoring, streams, verdicts  # noqa: F401
from textguard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
