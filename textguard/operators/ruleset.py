"""Rules that come as a table, of any number.

A rule is found without running its pattern on every text. From a pattern follow literals
of which one must occur wherever it matches; one stretch of three characters of each is its
entry in an inverted index. A text's stretches that are in the index, which a bitmap of
fixed size tells but for few, meet the entries in a join; what holds the whole literal is
handed to the pattern, which comes from the rule's column. Rules without such a literal
run on every text.

With at most ``FEW`` entries each text is searched for the literals themselves, without an index.
An index of at most ``BROADCAST`` entries goes to the texts, so that texts are not shuffled.
A larger one meets ``(key, stretch)`` rows, and only found pairs of key and rule go back to
the texts; rules without a literal then go to the texts in blocks of that size.

Defined cases: a null or empty text has no finding. Invalid patterns are left out and
reported by ``rejected``; a null pattern is one. Rules of equal names are
different rules. An empty table of rules finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as op
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions import spans
from textguard.functions.dialect import to_java
from textguard.functions.text import folded, markless
from textguard.operators.fence import fenced
from textguard.session import ship

#: Characters of an index entry.
STRETCH = 3
#: Up to so many entries each text is searched for each literal, which costs about 1 ns a character and
#: literal; to list and look up a text's stretches costs as much as some hundred of those.
FEW = 100
#: Entries that are handed to every task at most.
BROADCAST = 20_000
#: The bitmap has ``64 * WORDS`` bits.
WORDS = 1 << 14
_COMMON = set("etaoinshrdlu ")
_REPEATS = {op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT}


def _longer(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The choice of literals whose shortest is longer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda c: min(map(len, c)))


def _required(tree) -> list[str] | None:
    """Literals of which one is in every match, folded; nothing if none is known."""
    best, run = None, ""
    for kind, value in tree:
        ch = chr(value).lower() if kind is op.LITERAL else ""
        if len(ch) == 1 and ch.isascii():
            run += ch
            continue
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        best, run, inner = _longer(best, [run] if run else None), "", None
        if kind in _REPEATS and value[0] > 0:
            inner = _required(value[2])
        elif kind is op.SUBPATTERN:
            inner = _required(value[-1])
        elif kind is op.ATOMIC_GROUP:
            inner = _required(value)
        elif kind is op.BRANCH:
            ways = [_required(way) for way in value[1]]
            inner = sorted({w for way in ways for w in way}) if all(ways) else None
        best = _longer(best, inner)
    return _longer(best, [run] if run else None)


def analysed(pattern: str | None) -> tuple[str | None, list[str], str | None]:
    """JVM form of a pattern, literals of which one must occur, and what is wrong with it."""
    if pattern is None:
        return None, [], "no pattern"
    try:
        # What only the other engine writes becomes something that is no literal.
        common = re.sub(r"\\[pP](?:\{\^?\w+\}|\w)|\\x\{[0-9A-Fa-f]+\}", r"\\w", pattern).replace(r"\z", r"\Z")
        tree, java = _parser.parse(common), to_java(pattern)
    except (re.error, ValueError, IndexError, OverflowError, RecursionError) as err:
        return None, [], f"{type(err).__name__}: {err}"
    literals = _required(tree) or []
    return java, literals if literals and min(map(len, literals)) >= STRETCH else [], None


_ANALYSED = T.StructType([
    T.StructField("java", T.StringType()),
    T.StructField("literals", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


@F.pandas_udf(_ANALYSED)
def _analyse(patterns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analysed(p) for p in patterns], columns=["java", "literals", "error"])


def _checked(rules: DataFrame) -> DataFrame:
    ship(rules.sparkSession)
    return fenced(rules.withColumn("_a", _analyse(F.col("pattern"))), "_a")


def rejected(rules: DataFrame) -> DataFrame:
    """The rules that cannot be used, with ``error``."""
    return _checked(rules).where("_a.error IS NOT NULL").select(*rules.columns, F.col("_a.error").alias("error"))


def _entry(literal: Column) -> Column:
    """The stretch of a literal with the fewest common letters; the last of equals."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(literal) - (STRETCH - 1)),
        lambda i: F.struct(
            F.length(F.translate(F.substring(literal, i, F.lit(STRETCH)), "".join(sorted(_COMMON)), "")).alias("rare"),
            i.alias("at"),
            F.substring(literal, i, F.lit(STRETCH)).alias("stretch"),
        ),
    )
    return F.array_max(each)["stretch"]


def indexed(rules: DataFrame) -> DataFrame:
    """``(stretch, literal, earlier, java, rule)``: an entry for each literal of each rule, ``rule``
    being the rule's row; ``earlier`` are the rule's literals before it. A rule without one
    has one entry without a stretch."""
    known = _checked(rules).where("_a.error IS NULL").select("_a.java", "_a.literals", F.struct(*rules.columns).alias("rule"))
    each = known.select("java", "literals", "rule", F.posexplode_outer("literals").alias("at", "literal"))
    entry = F.when(F.col("literal").isNull(), "").otherwise(_entry(F.col("literal")))
    earlier = F.slice("literals", 1, F.coalesce("at", F.lit(0)))
    return each.select(entry.alias("stretch"), "literal", earlier.alias("earlier"), "java", "rule")


def _hashed(stretch: Column) -> Column:
    return F.pmod(F.xxhash64(stretch), F.lit(64 * WORDS))


def _bitmap(entries: DataFrame) -> Column:
    """``WORDS`` longs with a bit for each stretch of the index."""
    spots = entries.where("stretch != ''").select(_hashed(F.col("stretch")).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h % 64 as int))")
    some = spots.groupBy(F.expr("cast(h div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = entries.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("word")).join(F.broadcast(some), "word", "left")
    whole = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    return whole.select(F.transform("all", lambda w: w["bits"])).scalar()


def _stretches(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """``texts`` with ``_stretches``: the different stretches of the folded text that may be in the index."""
    every = F.regexp_extract_all("_fold", F.lit(f"(?s)(?=(.{{{STRETCH}}}))"), F.lit(1))
    with_map = texts.withColumn("_bits", _bitmap(entries))

    def listed(s: Column) -> Column:
        h = _hashed(s)
        word = F.get(F.col("_bits"), F.floor(h / 64).cast("int"))
        return F.call_function("getbit", word, (h % 64).cast("int")) == 1

    return with_map.withColumn("_stretches", F.array_distinct(F.filter(every, listed))).drop("_bits")


def _holds(fold: str = "_fold") -> Column:
    """Whether the text has the entry's literal, and none of the rule's literals before it."""
    none = ~F.exists("earlier", lambda w: F.contains(F.col(fold), w))
    return F.col("literal").isNull() | F.contains(F.col(fold), F.col("literal")) & none


def _prepared(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    own = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("_text"))
    safe = own.withColumn("_safe", markless(F.col("_text"))).withColumn("_fold", folded(F.col("_safe")))
    return fenced(safe, "_fold")


def _found(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs each pair's pattern on its text."""
    marked = F.regexp_replace("_safe", F.col("java"), F.lit(f"{spans.MARK}$0{spans.MARK}"))
    parts = fenced(pairs.select(*keys, "_text", "rule", F.split(marked, spans.MARK, -1).alias("_parts")), "_parts")
    hits = parts.where(F.size("_parts") > 1).withColumn("m", F.explode(spans.located(F.lit(0), F.col("_parts"))))
    value = F.substring(F.col("_text"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    return hits.select(*keys, "rule.*", F.col("m.start").alias("start"), F.col("m.end").alias("end"), value.alias("value"))


def findings(df: DataFrame, rules: DataFrame, keys: Sequence[str], text: str = "text", most: int = BROADCAST) -> DataFrame:
    """One row per match: ``keys``, the columns of the rule, ``start``, ``end``, ``value``.

    ``rules`` has a column ``pattern``; its columns are not named like the keys, ``start``,
    ``end`` or ``value``. With more than ``most`` index entries ``keys`` must name a text.
    """
    entries = indexed(rules).persist()
    texts = _prepared(df, keys, text)
    size = entries.groupBy((F.col("stretch") == "").alias("everywhere")).count().collect()
    count = {r["everywhere"]: r["count"] for r in size}
    if sum(count.values()) <= min(FEW, most):
        return _found(texts.join(F.broadcast(entries), _holds()), keys)
    if sum(count.values()) <= most:
        hits = F.concat(F.array(F.lit("")), F.col("_stretches"))
        seen = fenced(_stretches(texts, entries), "_stretches").withColumn("stretch", F.explode(hits))
        return _found(seen.join(F.broadcast(entries), "stretch").where(_holds()), keys)
    seen = fenced(_stretches(texts, entries), "_stretches").select(*keys, F.explode("_stretches").alias("stretch"))
    pairs = seen.join(entries.where("stretch != ''"), "stretch").drop("stretch")
    found = _found(texts.join(pairs, list(keys)).where(_holds()), keys)
    numbered = entries.where("stretch = ''").withColumn(
        "_block", F.floor((F.row_number().over(Window.orderBy("java")) - 1) / most)
    )
    for block in range(-(-count.get(True, 0) // most)):
        some = numbered.where(F.col("_block") == block).agg(F.collect_list(F.struct("java", "rule")).alias("_some"))
        every = texts.withColumn("_e", F.explode(some.scalar()))
        found = found.unionByName(_found(every.select(*keys, "_text", "_safe", "_e.java", "_e.rule"), keys))
    return found
