"""Which rules match a text at all, told by RE2 in Arrow batches.

The catalogue is written in RE2 syntax, and Arrow's RE2 runs a pattern over a column in one
linear pass without captures. Most rules match few texts: rules are tried ``GROUP`` at a time as
one alternation, and one by one only on the texts that the alternation matches. The JVM's patterns,
which give the places, then run on these texts alone. Nothing is guessed: a rule that is told to be
absent has no match.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.rules.model import Rule

#: Rules of an alternation. With 4 to 8 the automaton stays small; with 16 some outgrow RE2's memory.
GROUP = 6
#: Bytes of text that one call takes, so that what it allocates is bounded; a longer text goes alone.
SLICE = 16_000_000
#: Shorter patterns that match the same texts.
SAME_TEXTS = {
    "pii_email_intl": r"[\p{L}\p{N}._%+\-]@[\p{L}\p{N}.\-]+\.[\p{L}]{2}",
}


def _numbers(texts: pa.Array, patterns: Sequence[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the patterns that match them."""
    rows, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int16)]
    for at in range(0, len(patterns), GROUP):
        group = patterns[at : at + GROUP]
        any_of = "|".join(f"(?:{p})" for _, p in group)
        some = np.flatnonzero(pc.match_substring_regex(texts, any_of).to_numpy(zero_copy_only=False))
        if not len(some):
            continue
        few = texts if len(some) == len(texts) else texts.take(pa.array(some))
        for n, pattern in group:
            own = some[pc.match_substring_regex(few, pattern).to_numpy(zero_copy_only=False)]
            rows.append(own)
            numbers.append(np.full(len(own), n, np.int16))
    return np.concatenate(rows), np.concatenate(numbers)


def listed(texts: pa.Array, patterns: Sequence[tuple[int, str]]) -> pa.Array:
    """For each text the numbers of the patterns that match it, rising."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE)) + 1
    rows, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int16)]
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        r, n = _numbers(pc.fill_null(texts.slice(a, b - a), ""), patterns)
        rows.append(r + a)
        numbers.append(n)
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.lexsort((number, row))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(number[order], pa.int16()))


def rules_in(text: Column, rules: Sequence[tuple[int, Rule]]) -> Column:
    """Array of the numbers of the ``rules`` that match the text."""
    patterns = [(n, SAME_TEXTS.get(r.name, r.regex)) for n, r in rules]

    def found(texts: pa.Array) -> pa.Array:
        return listed(texts, patterns)

    # RE2 matches no class with bytes that are not UTF-8; the JVM reads them as U+FFFD.
    return F.arrow_udf(found, T.ArrayType(T.ShortType()))(F.make_valid_utf8(text))
