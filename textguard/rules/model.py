"""Rule records shared by every pack of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern. ``regex`` is RE2 syntax; ``dialect.to_java`` adapts it."""

    name: str
    severity: str
    regex: str
    about: str = ""


@dataclass(frozen=True)
class Gate:
    """A cheap necessary condition for a rule to match.

    ``words``: groups of literals, tested on the case-folded text; every group
    must have at least one literal present.
    ``digits``: a regex tested on the digit skeleton of the text (runs of
    digits, everything between two runs replaced by one space).
    ``alternatives``: gates of which one must pass, for rules with branches.
    A gate may let a text through for nothing, but never drops a match.
    """

    words: tuple[tuple[str, ...], ...] = ()
    digits: str = ""
    alternatives: tuple[Gate, ...] = ()


def g(*words, digits: str = "") -> Gate:
    """Shorthand: a bare string is a group of one literal."""
    groups = tuple((w,) if isinstance(w, str) else tuple(w) for w in words)
    return Gate(groups, digits)


def either(*gates: Gate) -> Gate:
    """Passes when one of ``gates`` passes."""
    return Gate(alternatives=gates)


def literals_of(gate: Gate) -> set[str]:
    """Every literal a gate looks for."""
    own = {w for group in gate.words for w in group}
    return own.union(*(literals_of(a) for a in gate.alternatives))
