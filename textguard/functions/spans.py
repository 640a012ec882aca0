"""Match spans as native array columns: where they are, and text rebuilt over them.

Offsets count characters. A match is ``struct<start, n, end, value>``, ``n``
being the position of its rule in the catalogue slice that was scanned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.text import MARK, quoted

MATCH_TYPE = "array<struct<start:int,n:int,end:int,value:string>>"
_BLOCK = 64


def marked_parts(text: str, java: str) -> str:
    """SQL for the text split around the matches; odd parts are the matches."""
    marked = f"regexp_replace({text}, {quoted(java)}, {quoted(f'{MARK}$0{MARK}')})"
    return f"split({marked}, {quoted(MARK)}, -1)"


def _running(lengths: Column, first: Column) -> Column:
    """Sum of the lengths before each element, added to ``first``."""
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct(
        (acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")
    )
    return F.aggregate(lengths, zero, step)["out"]


def starts_of(parts: Column) -> Column:
    """Start offset of each part. Long lists go block by block, so that the
    appends copy a block and not the whole list."""
    size = F.size(parts)
    width = F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(size)).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), size - 1, width),
        lambda at: F.transform(F.slice(parts, at + 1, width), F.length),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    offsets = F.arrays_zip(_running(sums, F.lit(0)).alias("first"), blocks.alias("block"))
    long = F.flatten(F.transform(offsets, lambda o: _running(o["block"], o["first"])))
    return F.when(size <= _BLOCK, _running(F.transform(parts, F.length), F.lit(0))).otherwise(long)


def located(n: Column, parts: Column) -> Column:
    """Matches of one rule from its marked parts."""
    placed = F.arrays_zip(starts_of(parts).alias("start"), parts.alias("value"))
    odd = F.filter(placed, lambda _, i: i % 2 == 1)
    return F.transform(
        odd,
        lambda p: F.struct(
            p["start"].alias("start"),
            n.alias("n"),
            (p["start"] + F.length(p["value"])).alias("end"),
            p["value"].alias("value"),
        ),
    )


def disjoint(spans: Column) -> Column:
    """Spans sorted by (start, -end) with overlapping ones dropped: first wins.

    Expects ``struct<start, end, put>``.
    """
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .otherwise(F.when(a["put"] < b["put"], -1).when(a["put"] > b["put"], 1).otherwise(0)),
    )
    # A span survives when no earlier survivor reaches past its start. Survivors
    # are disjoint and sorted, so the last one decides.
    empty = F.slice(ordered, 1, 0)
    last_end = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(
        ordered,
        empty,
        lambda kept, s: F.when(s["start"] >= last_end(kept), F.array_append(kept, s)).otherwise(kept),
    )


def rebuilt(text: Column, kept: Column) -> Column:
    """Text with each disjoint span replaced by its ``put`` string."""
    parts = F.transform(
        F.sequence(F.lit(0), F.size(kept)),
        lambda i: F.concat(
            F.when(i > 0, F.coalesce(F.get(kept, i - 1)["put"], F.lit(""))).otherwise(F.lit("")),
            F.substring(
                text,
                F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)) + 1,
                F.coalesce(F.get(kept, i)["start"], F.length(text))
                - F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)),
            ),
        ),
    )
    return F.when(F.size(kept) > 0, F.array_join(parts, "")).otherwise(text)
