"""The rule catalogue: packs in scan order, their gates and JVM patterns."""

from textguard.rules import (
    compliance,
    financial,
    international,
    secrets,
    us_core,
    us_extended,
    xss,
)
from textguard.rules.model import Gate, Rule

# Pack names, in scan order.
PACKS = {
    "secrets": secrets.RULES,
    "xss": xss.RULES,
    "pii-us-core": us_core.RULES,
    "pii-us-extended": us_extended.RULES,
    "pii-financial": financial.RULES,
    "pii-international": international.RULES,
    "compliance": compliance.RULES,
}

GATES: dict[str, Gate] = {}
for _pack in (secrets, xss, us_core, us_extended, financial, international, compliance):
    GATES.update(_pack.GATES)


def rules_of(*packs: str) -> list[tuple[str, Rule]]:
    """(pack, rule) pairs of the named packs, all packs when none is named."""
    names = packs or tuple(PACKS)
    return [(p, r) for p in names for r in PACKS[p]]
