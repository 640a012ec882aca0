"""Severity names, levels and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named severities from low to high.
LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
UNKNOWN_LEVEL = 0
DEFAULT_THRESHOLD = "high"
# The editor view also knows "info", and takes unknown names as medium.
EDITOR_LEVELS = {**LEVELS, "info": 1}
EDITOR_DEFAULT = 2


def level(severity: Column, levels: dict[str, int] = LEVELS, unknown: int = UNKNOWN_LEVEL) -> Column:
    chain = F.when(severity.isNull(), unknown)
    for name, value in levels.items():
        chain = chain.when(severity == name, value)
    return chain.otherwise(unknown)


def meets(severity: Column, threshold: Column | str) -> Column:
    """Severity at or above the threshold; an unknown threshold means high."""
    limit = F.lit(threshold) if isinstance(threshold, str) else threshold
    return level(severity) >= level(limit, unknown=LEVELS[DEFAULT_THRESHOLD])


def meets_in_editor(severity: Column, threshold: Column | str) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, str) else threshold
    return level(severity, EDITOR_LEVELS, EDITOR_DEFAULT) >= level(limit, LEVELS, EDITOR_DEFAULT)


def score_of(severity: Column) -> Column:
    """Name to the 2-5 scale of the guard; anything unnamed counts as high."""
    return F.when(severity == "critical", 5).when(severity == "medium", 3).when(severity == "low", 2).otherwise(4)


def name_of(score: Column) -> Column:
    """1-5 scale back to a name."""
    return (
        F.when(score >= 5, "critical").when(score >= 4, "high").when(score >= 3, "medium").otherwise("low")
    )
