"""Line dedup: a line that several documents hold stays in the first of them only.

Lines become 128-bit hashes of their keys. The narrow rows (hash, document,
position) are range-partitioned by hash and sorted by document and position within
it. A window streams over each sorted range, with no further shuffle or sort, and
gives every row the first document of its hash. Hashes with many of all rows, of
which there are at most ``1 / SHARE``, are cut into stripes, each a run of its own;
their first documents come from one row per hash. Lines found later are gathered as
bits, and a document's result is a list of the 64-bit words of its keep bitmap that
are not all ones. Texts are neither sorted nor grouped.

Defined cases: a null or empty text is one empty line. A null ``doc_id`` is one
document that comes after all others. Rows that repeat a ``doc_id`` are parts of
one document, which holds its lines in all of them. Other columns pass unchanged;
columns named ``n_lines``, ``n_dropped`` or ``kept`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.store import stored
from textguard.operators.fence import fenced

#: Characters stripped from both ends of a line.
BLANK = " \t\n\u000b\f\r"
#: Shorter keys are never repeats.
MIN_KEY = 10
#: Hashes with more than this share of all lines are cut into stripes.
SHARE = 0.001
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() also maps letters beyond A-Z; it is only right for one-byte texts.
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Adds the key of a row: its document, and the hash of its text."""
    return df.withColumns(
        {"_id": F.coalesce(F.col(doc).cast("long"), F.lit(_LAST)), "_row": F.xxhash64(F.col(text))}
    )


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``(_id, _row, n_dropped, keep)`` of each row that loses lines.

    ``keep`` holds ``struct<word, bits>``: bit ``i`` of word ``w`` says whether line
    ``64 * w + i`` stays. Words that are not listed keep all their lines.
    """
    rows = _row_key(docs.select(doc, text), doc, text)
    each = rows.select("_id", "_row", F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    keyed = each.select("_id", "_row", "pos", F.inline(F.array(F.struct(line_key(F.col("line")).alias("key")))))
    hashed = keyed.where(F.length("key") >= min_key).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "_id", "pos", "_row"
    )
    rows = stored(hashed, "lines")
    # All hashes with more than a SHARE of the rows are among these, and no more than 1 / SHARE of them.
    # Written, as which others are among them depends on the order in which tasks' finds meet.
    often = stored(rows.stat.freqItems(["h1"], SHARE).select(F.explode("h1_freqItems").alias("h1")), "often")
    often = often.withColumn("_often", F.lit(True))
    marked = rows.join(F.broadcast(often), "h1", "left")
    firsts = marked.where("_often").groupBy("h1", "h2").agg(F.min("_id").alias("_first"))
    stripes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripe = F.when(F.col("_often"), F.pmod(F.xxhash64("_id", "pos"), F.lit(stripes))).otherwise(0)
    key = ["h1", "h2", "stripe"]
    ordered = marked.withColumn("stripe", stripe).repartitionByRange(*key).sortWithinPartitions(*key, "_id", "pos")
    # The window has the ranges' partitioning and order, so it streams over them as they are.
    run = Window.partitionBy(*key).orderBy("_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = ordered.withColumn("first", F.first("_id").over(run))
    # A hash in stripes has its first document in one of them; a row for each such hash.
    met = seen.join(F.broadcast(firsts), ["h1", "h2"], "left")
    later = met.where(F.col("_id") > F.coalesce("_first", "first"))
    bits = later.groupBy("_id", "_row", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return bits.groupBy("_id", "_row").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay."""
    rows = _row_key(docs.drop("n_lines", "n_dropped", "kept", "keep"), doc, text)
    # Hashed, not sorted: whole texts stay out of the sorter.
    joined = rows.join(bitmaps.hint("shuffle_hash"), ["_id", "_row"], "left").drop("_id", "_row")
    words = F.map_from_entries("keep")
    split = joined.withColumn("_lines", _lines(F.col(text)))
    dense = split.withColumn(
        "_words",
        F.when(
            F.col("keep").isNotNull(),
            F.transform(
                F.sequence(F.lit(0), F.shiftright(F.size("_lines") - 1, 6)),
                lambda w: F.coalesce(words[w], F.lit(-1).cast("long")),
            ),
        ),
    )
    held = fenced(dense, "_lines", "_words")
    stays = lambda _, i: F.expr("1L").bitwiseAND(
        F.call_function("shiftright", F.get("_words", F.shiftright(i, 6)), i % 64)
    ) == 1
    kept = F.when(F.col("_words").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.filter("_lines", stays), "\n")
    )
    return held.select(
        *[c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept", "keep")],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    return apply_bitmaps(docs, keep_bitmaps(docs, doc, text, min_key), doc, text)
