"""Benchmark decontamination: test items inside long documents, by containment.

A document is reduced to its five-word shingles that occur in any test item: its
shingles stream past a broadcast Bloom filter of fixed size, and only hits are
shuffled. Equal reductions are searched once. Reductions are partitioned by size;
each partition has the band width that its upper size needs for an item of that size
class, so that a containment of 0.8 is found with a probability of ``1 - MISS`` at
least. Where no band width reaches that (a document with more than about fifteen
items of that size), items and reductions are joined on the shingles themselves.
Every candidate is verified by exact containment.

Defined cases: an item with fewer than five words has one shingle of all its words, and
documents then have the windows of that many words too; without such items they have none.
In scripts without spaces each letter is a word. Null and empty texts have no shingles and
match nothing. What so few words say is no sign of a test item where many documents say it:
an item of fewer than five words is not searched for if more than ``COMMON`` of the documents
hold it, and more than ``COMMON_LEAST``. The SQL of the query knows neither short items nor
those scripts; the given tables hold none. Repeated rows of a ``doc_id`` or ``item_id`` are
one document or item with the shingles of all. A null id is an id like others. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm import bloom
from textguard.llm.store import stored
from textguard.operators.fence import fenced

WORDS = 5
#: Containment in tenths.
TENTHS = 8
HASHES = 128
MISS = 1e-4
#: Share of the documents, and number of them, up to which an item of few words is rare.
COMMON = 0.01
COMMON_LEAST = 10
_WIDTHS = (8, 4, 2, 1)


#: Letters of scripts that put no spaces between words.
_UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; letters of scripts without spaces one by one."""
    body = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(body.rlike(_UNSPACED), F.regexp_replace(body, f"({_UNSPACED})", " $1 ")).otherwise(body)
    return F.filter(F.split(spaced, "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")


def _windows(n: int) -> Column:
    """The hashes of all windows of so many words."""
    each = F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, n)]))
    return F.slice(each, 1, F.greatest(F.size("_words") - (n - 1), F.lit(0)))


def _grams(df: DataFrame, text: str, *widths: int) -> DataFrame:
    """Adds ``grams``, the hashes of all five-word shingles and of the windows of ``widths``."""
    df = fenced(df.withColumn("_words", words_of(F.col(text))), "_words")
    return df.withColumn("grams", F.concat(*[_windows(n) for n in (WORDS, *widths)])).drop("_words")


def _item_grams(df: DataFrame, text: str) -> DataFrame:
    """Adds ``grams``, the hashes of all five-word shingles, or of all words if they are fewer,
    and ``few``, whether they are."""
    df = fenced(df.withColumn("_words", words_of(F.col(text))), "_words")
    # Words beyond the end are null, which a hash passes over.
    short = F.array(F.xxhash64(*[F.get("_words", F.lit(k)) for k in range(WORDS - 1)]))
    df = df.withColumn("few", F.size("_words").between(1, WORDS - 1))
    return df.withColumn("grams", F.when(F.col("few"), short).otherwise(_windows(WORDS))).drop("_words")


def _short_widths(items: DataFrame, text: str) -> list[int]:
    """How many words the items have that have fewer than five: four numbers at most."""
    counts = items.select(F.size(words_of(F.col(text))).alias("n")).where(F.col("n").between(1, WORDS - 1)).distinct()
    return sorted(r["n"] for r in counts.collect())


def _sized(asked: DataFrame) -> DataFrame:
    return asked.withColumn("n_item", F.size("item")).withColumn("a", _class("n_item"))


def _rare(asked: DataFrame, reduced: DataFrame, documents: int) -> DataFrame:
    """The items without the shingles of few words that too many documents hold."""
    most = max(COMMON_LEAST, COMMON * documents)
    often = reduced.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") > most)
    common = often.join(asked.select(F.explode("short").alias("g")).distinct(), "g", "left_semi").select("g")
    left = asked.select("item_id", F.explode("item").alias("g")).join(common, "g", "left_anti")
    return _sized(left.groupBy("item_id").agg(F.collect_set("g").alias("item")))


def width(item_class: int, set_class: int) -> int:
    """Rows per band for items of ``2**a`` and sets of ``2**p`` shingles and up, below the
    next power of two; 0 where no width finds all but ``MISS`` of them."""
    least, most = 2**item_class, 2 ** (set_class + 1) - 1
    t = TENTHS / 10
    similar = min(1.0, t * least / (least + most - t * least))
    return next((r for r in _WIDTHS if (1 - similar**r) ** (HASHES // r) <= MISS), 0)


def _class(size: str) -> Column:
    return F.floor(F.log2(F.col(size))).cast("int")


def _signature(grams: str) -> Column:
    least = lambda s: F.array_min(F.transform(grams, lambda g: F.xxhash64(s, g)))
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), least)


def _bands(df: DataFrame, *keep: str) -> DataFrame:
    """One row per band: ``df`` has ``sig``, the width ``r`` and the set class ``p``."""
    each = F.transform(
        F.sequence(F.lit(0), F.floor(F.lit(HASHES) / F.col("r")).cast("int") - 1),
        lambda b: F.xxhash64(F.col("r"), F.col("p"), b, F.slice(F.col("sig"), b * F.col("r") + 1, F.col("r"))),
    )
    return df.select(*keep, F.explode(each).alias("band"))


def contained(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)`` of each document that holds at least eight
    tenths of an item's shingles."""
    asked = _item_grams(items.select(F.col(item).alias("item_id"), F.col(text).alias("text")), "text")
    asked = asked.select("item_id", "few", F.explode("grams").alias("g")).groupBy("item_id")
    asked = stored(_sized(asked.agg(F.collect_set("g").alias("item"), F.collect_set(F.expr("IF(few, g, NULL)")).alias("short"))), "items")
    short = _short_widths(items, text)
    known = asked.select(F.explode("item").alias("g")).distinct()
    table = bloom.bloom_table(known, "g")
    each = _grams(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text", *short)
    hits = bloom.maybe_in(each.select("doc_id", F.explode("grams").alias("g")), "g", table)
    reduced = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("g")).alias("grams"))
    reduced = stored(reduced.withColumns({"k1": F.xxhash64("grams"), "k2": F.xxhash64(F.lit("set"), "grams")}), "reduced")
    if short:
        asked = stored(_rare(asked, reduced, docs.select(doc).distinct().count()), "rare")
    sets = reduced.groupBy("k1", "k2").agg(F.first("grams").alias("grams"))
    sets = sets.withColumn("n", F.size("grams")).withColumn("p", _class("n"))
    sets = stored(sets.withColumn("sig", _signature("grams")), "sets")

    # A set under eight tenths of the item's size cannot hold it: two classes below at most.
    classes = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(p).alias("p"), F.lit(width(a, p)).alias("r"))
        for a in range(31) for p in range(max(0, a - 1), 31)
    ])
    pairs = asked.sparkSession.range(1).select(F.inline(classes))
    banded = pairs.where("r > 0")
    item_bands = _bands(
        asked.withColumn("sig", _signature("item")).join(F.broadcast(banded), "a"), "item_id", "p", "r"
    )
    widths = banded.select("p", "r").distinct()
    set_bands = _bands(sets.join(F.broadcast(widths), "p"), "k1", "k2", "p", "r")
    near = item_bands.join(set_bands, ["p", "r", "band"]).select("item_id", "k1", "k2").distinct()
    # The exact way for the rest: joined on the shingles.
    asked_classes = asked.select("a").distinct()
    far = pairs.where("r = 0").select("a", "p").join(F.broadcast(asked_classes), "a")
    item_grams = asked.select("item_id", "a", F.explode("item").alias("g"))
    set_grams = sets.join(F.broadcast(far.select("p").distinct()), "p").select("k1", "k2", "p", F.explode("grams").alias("g"))
    rest = item_grams.join(set_grams, "g").join(F.broadcast(far), ["a", "p"]).select("item_id", "k1", "k2").distinct()
    found = near.union(rest)
    held = found.join(asked.select("item_id", "item", "n_item"), found["item_id"].eqNullSafe(asked["item_id"])).drop(found["item_id"])
    held = held.join(sets.select("k1", "k2", "grams"), ["k1", "k2"])
    held = held.withColumn("n_shared", F.size(F.array_intersect("item", "grams")))
    held = held.where(F.col("n_shared") * 10 >= F.col("n_item") * TENTHS).select("k1", "k2", "item_id", "n_shared", "n_item")
    return reduced.select("doc_id", "k1", "k2").join(held, ["k1", "k2"]).select("doc_id", "item_id", "n_shared", "n_item")


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc_id)`` of the documents that hold an item."""
    return contained(docs, items, doc).select("doc_id").distinct()
