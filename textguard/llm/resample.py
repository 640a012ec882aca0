"""Importance resampling: documents drawn by how much their n-grams look like a target's.

Features of a text are all runs of 1 to ``LONGEST`` consecutive words, hashed into
``BUCKETS``. Buckets are counted over the source and over the target; the logarithm of
the ratio of the two smoothed shares is a bucket's gain, and a document's weight the
mean gain of its features. Gumbel noise from a digest of the id is added to the weight,
so the highest scores are a sample without replacement by weight.

Texts go through numpy in batches of bounded size. The texts of a batch are joined with a
separator that no word holds, and one pass of a pattern over the whole finds all words.
The text of a word is the place of its start among the texts' starts (``searchsorted``);
runs that begin and end in different texts are masked out, and what is left is counted by
``bincount``. A run's CRC-32 comes from the CRCs of its words: the polynomial's shift by a
word's length is four table look-ups, so no run is ever built as a string.

What reaches the driver are the two bucket counts, ``BUCKETS`` numbers each. The draw sorts
narrow rows by range (``numbering``).

Defined cases: a null or empty text has no word and no feature, weight 0, and is never
drawn; a null id counts as the empty string in the noise and comes first among ties.
Repeated rows are weighed each on its own and are neighbours in the order. Very long texts are one batch of
their own. Columns beside the id and the text are not read. Empty tables give empty
results; without a target all its counts are 0.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.numbering import numbered
from textguard.llm.store import in_arrow, stored

BUCKETS = 10_000
LONGEST = 2
#: Least words of a document that may be drawn, and the share of them that is.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Words of a lower-cased text: runs of digits, letters a to z and all that is not ASCII.
_WORD = re.compile(b"[0-9a-z\x80-\xff]+")
#: Bytes of text in a batch, and the longest word whose CRC is computed in step with others.
_BATCH = 4_000_000
_STEPS = 64
_ONES = np.uint32(0xFFFFFFFF)


@functools.lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``b`` at place ``k`` of a CRC becomes after ``n`` more zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, np.uint32(0xEDB88320) ^ (one >> np.uint32(1)), one >> np.uint32(1))
    moved = np.empty((_STEPS + 1, 4, 256), np.uint32)
    moved[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(_STEPS):
        moved[n + 1] = one[moved[n] & 255] ^ (moved[n] >> np.uint32(8))
    return moved


def _shifted(crc: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """CRCs after ``by`` zero bytes each, but for the constants at both ends."""
    moved, low = _tables(), np.uint32(255)
    out = moved[by, 0, crc & low]
    for k in range(1, 4):
        out = out ^ moved[by, k, crc >> np.uint32(8 * k) & low]
    return out


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words in step, the longest ones first."""
    order = np.argsort(np.minimum(sizes, _STEPS + 1).astype(np.int16), kind="stable")[::-1]
    at, size = starts[order], sizes[order]
    step = _tables()[1, 0]
    state = np.full(len(order), _ONES, np.uint32)
    left = np.searchsorted(-np.minimum(size, _STEPS + 1), -np.arange(_STEPS + 1))  # words with more than p bytes
    for p in range(_STEPS):
        n = left[p]
        if n == 0:
            break
        state[:n] = step[(state[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ _ONES
    for i in np.flatnonzero(sizes > _STEPS):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


def features(texts: list[bytes], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, crc32)`` of all runs of one word, then of two, and so on."""
    joined = b"\0".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    spans = np.fromiter(chain.from_iterable(m.span() for m in _WORD.finditer(joined)), np.int64).reshape(-1, 2)
    starts, sizes = spans[:, 0], spans[:, 1] - spans[:, 0]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    word = _crcs(data, starts, sizes)
    yield owner, word
    space, run = np.uint32(zlib.crc32(b" ")), word
    far = np.flatnonzero(sizes > _STEPS)
    for n in range(1, longest):
        # What follows the run that starts at word i is word i + n.
        head = _shifted(run[:-1], 1) ^ space
        size = np.minimum(sizes[n:], _STEPS)
        run = _shifted(head, size) ^ word[n:]
        for i in far[far >= n]:
            run[i - n] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(head[i - n]))
        inside = owner[:-n] == owner[n:]
        yield owner[:-n][inside], run[inside]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with about ``_BATCH`` bytes of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // _BATCH)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                some = batch.slice(a, b - a)
                yield some, [t or b"" for t in some.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; buckets without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _batches(batches, 0):
            for _, crc in features(texts, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    counted = in_arrow(docs.select(F.col(text).alias("text")), run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from two tables of at most ``buckets`` counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, source), (t, target)):
        for row in table.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = [(b + 1.0) * all_s / ((a + 1.0) * all_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each document."""
    buckets = np.uint32(len(gain))
    values = gain.astype(np.float64)  # sums of whole numbers, exact in doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches, 1):
            n = len(texts)
            words, count, total = None, np.zeros(n, np.int64), np.zeros(n)
            for owner, crc in features(texts, longest):
                here = np.bincount(owner, minlength=n)
                words = here if words is None else words
                count += here
                total += np.bincount(owner, values[crc % buckets], n)
            weight = np.where(count > 0, total.astype(np.int64) // np.maximum(count, 1), 0)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_words long, n_features long, weight long")


def draw(
    weighed: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """``weighed`` with ``score``, and ``rank`` from 1 on for the documents that are drawn."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scored")
    may = F.col("n_words") >= least
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    placed = numbered(scored.where(may), [], order, "_place")
    size = scored.agg(F.count_if(may).alias("n"))
    drawn = placed.withColumn("_n", size.scalar())
    rank = F.when(F.expr(f"_place < _n * {percent} div 100"), F.col("_place") + 1)
    others = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, rank.alias("rank")).unionByName(others)


def resample(
    docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every document with ``n_words, n_features, weight, score, rank``."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return draw(weigh(docs, gain, doc, text), percent, least, seed)
