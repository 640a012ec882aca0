"""Keeps computed columns from being computed again by filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *computed: str) -> DataFrame:
    """The same rows, with ``computed`` handed through a one-row ``inline``.

    A filter on a computed column would otherwise be pushed below the projection
    that makes it, together with a copy of its whole expression; the optimizer
    cannot push anything through the generator's own output. Nor does it inline
    it: a column read inside an array function would else be computed anew for
    each element. ``inline`` and not ``explode``, because the optimizer moves the
    access to a field of an exploded struct below the generator again.
    """
    rest = [c for c in df.columns if c not in computed]
    return df.select(*rest, F.inline(F.array(F.struct(*computed)))).select(*df.columns)
