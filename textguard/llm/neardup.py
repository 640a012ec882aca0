"""Near-duplicates by DartMinHash over weighted five-word shingles.

A text is the weighted set of its five-word shingles, weighed by how often they occur.
Each element owns a region as high as its weight; darts come in the order of their rank
from a process seeded by the element alone, and each names a coordinate. The earliest
dart inside the regions of a text is the text's value at that coordinate, and two texts
agree there with a probability of their weighted Jaccard similarity. Darts are thrown
up to a rank that fills the coordinates of a text of that weight; it doubles until all
are filled, so texts of any length cost about the same beyond one look at each shingle.

Bands of coordinates are joined through buckets. Exact copies count once. A bucket
links each member to its least one, which leaves most buckets with a single class. In the
others, the members outside the largest class are compared with all members of small
classes and a few of large ones, and those that then still stand apart with all. Texts which
have too little in common with all other classes to be similar to a member of one leave
before anything is paired, so that a passage that many different texts share pairs none of
them; copies inside a class are never paired, nor are texts whose parity bits show that
they differ in too many elements. Every link is verified on the exact weighted
similarity. Classes are the connected components of the links.

Defined cases: words are those between white space, in lower case. Texts with fewer than
five words are near-duplicates only of texts with the same words; null and empty texts
are alike. Rows with a null id are left out of the search and get no class. Rows that
repeat an id are one document when their text is the same; otherwise the class of the
id is that of all its texts. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm import bloom
from textguard.llm.components import components
from textguard.llm.pieces import Kept
from textguard.llm.store import in_arrow, stored

WORDS = 5
SIMILAR = 0.8
#: A pair at 0.8 is missed with a probability of (1 - 0.8 ** 6) ** 32, 6e-5.
ROWS = 6
BANDS = 32
#: About so many members of a bucket its strays meet first.
PICKS = 16
#: Bits that sum up a set; the bound they give is sharp for sets of up to about as many elements.
PARITY = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = Kept(xxhash.xxh64_intdigest)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a well-known finalizer)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text, in order; of all words if fewer."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, max(len(h), 1))
    if not len(h):
        return np.zeros(1, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mixed(out * _MIX + h[k : len(h) - n + 1 + k])
    return out if n == WORDS else _mixed(out + np.uint64(n))


def weighted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and their weights."""
    return np.unique(grams, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = ROWS * BANDS) -> np.ndarray:
    """The value of the earliest dart at each coordinate, one row per weighted set."""
    # A region of weight w is cut in slabs of height one; the last may be lower.
    elements, weights = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
    owner = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
    slabs = np.ceil(weights).astype(np.int64)
    level = np.arange(int(slabs.sum())) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    seed = _mixed(np.repeat(elements, slabs) + _MIX * (level.astype(np.uint64) + np.uint64(1)))
    room = np.minimum(1.0, np.repeat(weights, slabs) - level)
    owner = np.repeat(owner, slabs)
    out = np.zeros((len(sets), size), np.uint64)
    limit = (size * math.log(size) + 2 * size) / np.bincount(owner, room, len(sets))
    open_ = np.ones(len(sets), bool)
    while open_.any():
        on = open_[owner]
        alive, space, of, rank, step = seed[on], room[on], owner[on], np.zeros(int(on.sum())), 0
        best = np.full(len(sets) * size, np.inf)
        thrown = []
        while len(alive):
            step += 1
            dart = _mixed(alive + np.uint64(step * int(_MIX) % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < limit[of]
            rank, alive, space, of, dart = rank[on], alive[on], space[on], of[on], dart[on]
            hit = (_mixed(dart ^ _MIX) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < space
            value = dart[hit]
            place = of[hit] * size + (_mixed(value + np.uint64(1)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, place, rank[hit])
            thrown.append((place, rank[hit], value))
        best = best.reshape(len(sets), size)
        done = open_ & np.isfinite(best).all(axis=1)
        flat = out.reshape(-1)
        for place, at, value in thrown:
            first = (at == best.reshape(-1)[place]) & done[place // size]
            flat[place[first]] = value[first]
        open_ &= ~done
        limit = limit * 2
    return out


def bands(signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signs.reshape(len(signs), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        out = _mixed(out * _MIX + parts[:, :, k])
    return out.view(np.int64)


def marked(grams: np.ndarray) -> np.ndarray:
    """A set that stands for the weighted set: each further occurrence of a shingle is an
    element of its own. Sorted hashes of 32 bits."""
    grams = np.sort(grams)
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    place = np.arange(len(grams))
    again = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.unique((_mixed(grams + again.astype(np.uint64) * _MIX) >> np.uint64(32)).astype("<u4"))


def parity(own: np.ndarray) -> bytes:
    """Whether an even or odd number of a set's elements falls on each of ``PARITY`` bits.

    Two sets differ in at least as many elements as these bits differ."""
    return np.packbits(np.bincount(own % PARITY, minlength=PARITY) & 1).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two ``marked`` sets."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared / (len(a) + len(b) - shared)


#: Texts that are signed together.
_TOGETHER = 64


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h1, h2, text) to (id, h1, h2, bands)."""
    for whole in batches:
        made = []
        for k in range(0, whole.num_rows, _TOGETHER):
            texts = whole.column(3).slice(k, _TOGETHER).to_pylist()
            made.append(bands(signatures([weighted(shingles(t)) for t in texts])))
        values = pa.array(np.concatenate(made).reshape(-1)) if made else pa.array([], pa.int64())
        ends = pa.array(np.arange(whole.num_rows + 1, dtype=np.int32) * BANDS)
        arrays = [whole.column(0), whole.column(1), whole.column(2), pa.ListArray.from_arrays(ends, values)]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "h1", "h2", "bands"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, grams, parity): the text's ``marked`` set as bytes, and its ``parity``."""
    for batch in batches:
        sets = [marked(shingles(t)) for t in batch.column(1).to_pylist()]
        sums = np.frombuffer(b"".join(map(parity, sets)), np.int64)
        ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (PARITY // 64))
        arrays = [batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(sums))]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "grams", "parity"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, grams of a, grams of b) to the pairs that are similar enough."""
    for batch in batches:
        kept = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
            near = min(len(x), len(y)) >= SIMILAR * max(len(x), len(y))
            kept.append(near and similarity(x, y) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grams) to (id, token), one row per element of the set."""
    for batch in batches:
        for i, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(g, "<u4").view("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own)], names=["id", "token"])


def _sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, grams, parity)``: the ``marked`` sets of the texts in ``ids``."""
    ids = stored(ids.select("id").distinct().withColumn("key", F.xxhash64("id")), "ids")
    # Only texts that are asked for are shuffled: the filter has a fixed size, the join is exact.
    some = bloom.maybe_in(texts.withColumn("key", F.xxhash64("id")), "key", bloom.bloom_table(ids, "key", 15), 15)
    grams = in_arrow(some.select("id", "text"), _featured, "id long, grams binary, parity array<bigint>")
    return stored(grams.join(ids.select("id"), "id", "left_semi").dropDuplicates(["id", "grams"]), "grams")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose exact similarity is high enough."""
    pairs = stored(pairs.distinct(), "pairs")
    grams = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), texts)
    both = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    both = both.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return in_arrow(both.select("a", "b", "x", "y"), _verified, "a long, b long")


def _mixed_buckets(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """``(key, id, n, root, main, size)`` of the buckets with several classes: a member's
    class, the class that most members of the bucket are in, and the class's size."""
    roots = components(links)
    placed = buckets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = placed.select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    each = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = each.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).where("k > 1")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    rows = placed.join(main.select("key", F.col("m.root").alias("main")), "key").join(sizes, "root", "left")
    return stored(rows.select("key", "id", "n", "root", "main", F.coalesce("size", F.lit(1)).alias("size")), "mixed")


def _bounded(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """``rest`` with ``all``, the elements of a member's set, ``common``, those that occur in
    some other class as well (no link to another class can share more), the set's ``parity``,
    and ``keys``, its buckets, of which there are no more than bands. An id with several
    texts has several sets, so that nothing bounds it: its first three are null."""
    ids = stored(rest.select("id", "root").distinct(), "ids")
    sets = _sets(ids.select("id"), texts)
    one = sets.groupBy("id").agg(F.count("*").alias("sets"), F.min("parity").alias("parity")).where("sets = 1").drop("sets")
    each = in_arrow(sets.select("id", "grams"), _tokens, "id long, token int").join(ids, "id")
    each = stored(each.select("token", "id", "root"), "tokens")
    spread = each.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
    common = each.join(spread, "token").groupBy("id").agg(F.count("*").alias("common"))
    counts = each.groupBy("id").agg(F.count("*").alias("all")).join(common, "id", "left")
    keys = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))
    counts = counts.select("id", "all", F.coalesce("common", F.lit(0)).alias("common")).join(one, "id")
    return stored(rest.join(keys.join(counts, "id", "left"), "id"), "bounded")


def _able(rest: DataFrame) -> DataFrame:
    """The members that can be similar to one of another class: a similar text shares that
    part of a set's elements at least, and no more than ``common`` of them can be shared."""
    return rest.where(f"`all` IS NULL OR common >= {SIMILAR} * `all` - 1e-6")


def _across(rest: DataFrame, picked: Column) -> DataFrame:
    """Pairs of a bucket's strays with its ``picked`` members of other classes, but for those
    that cannot be similar by what they have in common with any other class, or by the
    least number of elements in which they differ."""
    rest = _able(rest)
    side = lambda k: [F.col(c).alias(c[0] + k) for c in ("id", "root", "all", "common", "parity", "keys")]
    strays = rest.where("root != main").select("key", *side("x"))
    others = rest.where(picked).select("key", *side("y"))
    # shared / (ax + ay - shared) >= SIMILAR, for the most that they can share
    share = f"{1 + SIMILAR} * least(cx, cy) >= {SIMILAR} * (ax + ay) - 1e-6"
    differ = " + ".join(f"bit_count(px[{i}] ^ py[{i}])" for i in range(PARITY // 64))
    apart = f"{1 + SIMILAR} * ({differ}) <= {1 - SIMILAR} * (ax + ay) + 1e-6"
    # A pair meets in one bucket only, the first that it shares.
    once = "key = array_min(array_intersect(kx, ky))"
    pairs = strays.join(others, "key").where(f"rx != ry AND coalesce({share}, true) AND coalesce({apart}, true) AND {once}")
    return pairs.select(F.greatest("ix", "iy").alias("a"), F.least("ix", "iy").alias("b"))


def _compared(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join all similar members of buckets (``key``, ``id``), as ``(a, b)``."""
    stats = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    shared = stored(buckets.join(stats.where("n > 1"), "key"), "buckets")
    star = shared.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    links = stored(_links(star, texts), "links")
    rest = shared.select("key", "id", "n")
    few = F.pmod(F.xxhash64("key", "id"), F.greatest(F.lit(1), F.floor(F.col("n") / PICKS)).cast("long")) == 0
    for picked in ((F.col("size") <= PICKS) | few, F.lit(True)):
        rest = _bounded(_mixed_buckets(rest.select("key", "id", "n"), links), texts)
        links = stored(links.union(_links(_across(rest, picked), texts)), "links")
    return links


def near_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_spanning)`` per document: the least id of its class, and how many
    of the links that hold the class together were verified at its text. Links between texts
    that already are in one class are not looked for, so it is no count of similar texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("id"), body.alias("text"))
    keyed = rows.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"), "text")
    signed = stored(in_arrow(keyed, _signed, "id long, h1 long, h2 long, bands array<bigint>"), "signed")
    copies = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = stored(signed.select("id", "h1", "h2").distinct().join(copies, ["h1", "h2"]).select("id", "rep"), "members")
    reps = members.where("id = rep").select("id").distinct()
    bands_of = stored(signed.select("id", "bands").join(reps, "id", "left_semi"), "bands")
    each = bands_of.select("id", F.posexplode("bands").alias("band", "value"))
    buckets = each.select(F.xxhash64("band", "value").alias("key"), "id").distinct()
    links = stored(_compared(buckets, rows).distinct(), "links")
    # A document with several texts ties their classes.
    tied = members.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("a"))
    tied = tied.join(several, "a", "left_semi")
    roots = components(links.union(tied))
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("n_spanning"))
    known = members.groupBy("id").agg(F.min("rep").alias("rep"))
    placed = known.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("id", "rep"), "rep", "left")
    return placed.select(
        F.col("id").alias("doc_id"),
        F.coalesce("root", "rep").alias("class_id"),
        F.coalesce("n_spanning", F.lit(0)).alias("n_spanning"),
    )
