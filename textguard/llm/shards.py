"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a digest of its id modulo ``SLOTS``: it never changes, whatever the
number of shards. Bytes are summed per slot. The map says which shard holds a slot; a
rebalance is an edit of the map, a new version of it, and moves only the slots whose entry
changed. The map has at most ``SLOTS + shards * FINE`` rows, whatever the data.

A slot with more than ``1 / FINE`` of a shard's share (one id on many rows, or no id) is
cut into stripes: its rows are numbered in order, and every k-th row is one stripe. So
such a slot is spread as well, and only a single record is never cut.

Versions: 1 deals slots out in turn; ``balanced`` lets every entry stay whose shard has
room for it, from the largest on, and moves the others to the emptiest shard; ``grown``
adds a shard and moves entries into it only, from shards that are above the new share.

Law: the shards' sizes are near equal. Two differ by little more than the smallest entries of
the map, unless one record is larger than a shard's share.

Defined cases: a null id is hashed as the empty string, a null text has no bytes and
CRC 0. Repeated rows are records of their own, neighbours in the order of their slot.
Texts are only measured, so their length does not matter. Columns beside id and text are
not read. An empty table gives an empty map and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.numbering import numbered
from textguard.llm.store import stored

SLOTS = 4096
#: Entries of a shard's size at least that a slot is cut into.
FINE = 32
#: Bytes that a record takes beside its text.
HEAD = 16

_MAP = ["virtual_slot", "stripe", "stripes", "n", "bytes", "shard"]


def records(docs: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of each record."""
    key = F.md5(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary"))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc).alias("doc_id"),
        (F.octet_length(data) + HEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % slots).cast("int").alias("virtual_slot"),
    )


def placed(docs: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``records`` with ``place``, the number of a record in its slot. Texts are read once."""
    rows = stored(records(docs, doc, text, slots), "records")
    return numbered(rows, ["virtual_slot"], [F.col(c) for c in ("doc_id", "text_crc32", "size")], "place")


def first_map(rows: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots and their stripes, dealt out in turn."""
    slots = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))
    # At most SLOTS rows, each with the table's size beside it.
    wanted = F.ceil(F.col("b") * (shards * FINE) / F.sum("b").over(Window.partitionBy()))
    cut = slots.select("virtual_slot", F.least("c", F.greatest(F.lit(1), wanted)).cast("long").alias("stripes"))
    striped = rows.join(F.broadcast(cut), "virtual_slot").withColumn("stripe", F.col("place") % F.col("stripes"))
    entries = striped.groupBy("virtual_slot", "stripe", "stripes").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    shard = F.pmod(F.col("virtual_slot") + F.col("stripe"), F.lit(shards)).cast("int")
    return entries.withColumn("shard", shard)


def _edited(entries: DataFrame, loads: Column, shard: str, moved: str) -> DataFrame:
    """The map after one pass over its entries, the largest first.

    ``a`` is the state (``loads`` by shard, and the shards given so far), ``u`` an entry;
    ``shard`` chooses the entry's shard ``s``, ``moved`` is what shard ``i`` gains by it.
    """
    entry = F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "stripe", "stripes", "n", "bytes", "shard", "_share")
    step = f"""transform(array({shard}), s -> named_struct(
        'loads', transform(a.loads, (x, i) -> x + {moved}),
        'given', concat(a.given, array(s))))[0]"""
    all_ = entries.agg(F.sort_array(F.collect_list(entry)).alias("entries"), loads.alias("loads"))
    start = "named_struct('loads', loads, 'given', cast(array() as array<int>))"
    given = F.expr(f"aggregate(entries, {start}, (a, u) -> {step}, a -> a.given)")
    pairs = all_.select(F.explode(F.arrays_zip("entries", given.alias("given"))).alias("e"))
    return pairs.select(*[f"e.entries.{c}" for c in _MAP[:-1]], F.col("e.given").alias("shard"))


def _shared(entries: DataFrame, shards: int) -> DataFrame:
    """Entries with ``_share``: what a shard holds when all are equal, but for those that a
    single larger entry fills. The map is one small partition here."""
    order = Window.orderBy(F.col("bytes").desc(), "virtual_slot", "stripe")
    rest = F.sum("bytes").over(order.rowsBetween(0, Window.unboundedFollowing))
    left = F.lit(shards + 1) - F.row_number().over(order)
    ranked = entries.withColumn("_large", (left > 1) & (F.col("bytes") * left > rest))
    whole = Window.partitionBy()
    share = F.sum(F.when(~F.col("_large"), F.col("bytes"))).over(whole) / (shards - F.count_if("_large").over(whole))
    return ranked.withColumn("_share", F.ceil(share).cast("long")).drop("_large")


def balanced(entries: DataFrame, shards: int) -> DataFrame:
    """The next version: entries whose shard has no room for them go to the emptiest shard."""
    stay = "if(a.loads[u.shard] + u.bytes <= u._share, u.shard, cast(array_position(a.loads, array_min(a.loads)) as int) - 1)"
    empty = F.array_repeat(F.lit(0).cast("long"), shards)
    return _edited(_shared(entries, shards), empty, stay, "if(i = s, u.bytes, 0L)")


def grown(entries: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number ``shards`` added: it takes entries of the others."""
    move = f"""if(a.loads[{shards}] + u.bytes <= u._share and 2 * (a.loads[u.shard] - u._share) >= u.bytes,
        {shards}, u.shard)"""
    loads = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("bytes"))), F.lit(0)) for i in range(shards + 1)])
    return _edited(_shared(entries, shards + 1), loads, move, "if(s != u.shard, if(i = s, u.bytes, if(i = u.shard, -u.bytes, 0L)), 0L)")


def version(history: DataFrame, number: int) -> DataFrame:
    return history.where(F.col("version") == number).drop("version")


def map_history(rows: DataFrame, shards: int) -> DataFrame:
    """The written map in its versions: 1 as dealt, 2 balanced, 3 with one more shard."""
    one = stored(first_map(rows, shards).withColumn("version", F.lit(1)), "map-1")
    two = stored(balanced(one.drop("version"), shards).withColumn("version", F.lit(2)), "map-2")
    three = stored(grown(two.drop("version"), shards).withColumn("version", F.lit(3)), "map-3")
    return one.unionByName(two).unionByName(three)


def assign(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the record's place in its shard from 0 without gaps."""
    inside = Window.partitionBy("shard").orderBy("virtual_slot", "stripe").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(inside), F.lit(0))
    wide = entries.select("virtual_slot", "stripe", "stripes", "shard", offset.alias("_offset"))
    # Both tables have a bounded number of rows, see the module's text.
    cut = entries.select("virtual_slot", "stripes").distinct()
    striped = rows.join(F.broadcast(cut), "virtual_slot").withColumn("stripe", F.col("place") % F.col("stripes"))
    found = striped.join(F.broadcast(wide.drop("stripes")), ["virtual_slot", "stripe"])
    slot = F.expr("_offset + place div stripes")
    return found.select(*rows.columns, "stripe", "shard", slot.alias("slot"))
