"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; a policy is a mask over those bits, named by its version.
Verdicts under any policy, and what a policy would keep without one of its rules,
come from the stored bits alone.

Defined cases: a null or empty text has no words, fails ``few_words`` and is
rejected. Rows are judged one by one, so repeated rows get the same verdict. Other
columns pass unchanged; a column named like a measurement is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.fence import fenced

BLANK = " \t\n\u000b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"

#: Rule name, and the condition under which a document fails it. Bit i is rule i;
#: rules are only ever added at the end, so that stored ledgers stay readable.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_word_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("exclamations", "100 * n_exclaims > 30 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
)
_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Rules of each policy version.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    # Repeated lines alone also befall clean pages with menus; line dedup sees to them.
    "v1": tuple(rule for rule in _BIT if rule != "repeated_lines"),
    "strict": tuple(_BIT),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_exclaims", "n_capitals",
)


def mask(policy: str) -> int:
    """The bits of the rules in a policy."""
    return sum(_BIT[rule] for rule in POLICIES[policy])


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    return fenced(df.withColumns(columns), *columns)


def _covered(words: Column) -> Column:
    """How many words lie in a three-word window found twice or more."""
    windows = F.col("_windows")
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s, k: (s["h"] == F.get("_placed", k - 1)["h"]) | (s["h"] == F.get("_placed", k + 1)["h"])
    starts = F.sort_array(F.transform(F.filter("_placed", lambda s, k: F.coalesce(again(s, k), F.lit(False))), lambda s: s["i"]))
    reach = F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3))))
    return placed, starts, F.aggregate(reach, F.lit(0), lambda a, n: a + n)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements, all from one look at the whole text."""
    own = [c for c in docs.columns if c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(body, F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP, -1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    df = _held(docs.select(*own), _words=words, _lines=lines)
    grams = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = _held(df, _windows=F.slice(grams, 1, F.greatest(F.size("_words") - 2, F.lit(0))))
    placed, starts, count = _covered(F.col("_words"))
    # Few texts repeat a window: the others are done after one set of hashes.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = _held(df, _placed=F.when(repeats, placed))
    df = _held(df, _starts=F.when(F.col("_placed").isNotNull(), starts))
    only = lambda kept: F.length(F.regexp_replace(body, kept, ""))
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": only("[^#*$%&|<>]+"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_starts").isNotNull(), count).otherwise(0),
        "n_word_lines": F.size("_lines"),
        "n_exclaims": only("[^!]+"),
        "n_capitals": only("[^A-Z]+"),
    }
    return df.select(*own, *[made[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failed``, one bit per failed rule."""
    df = fenced(measured(docs.drop("failed"), text), *MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return df.withColumn("failed", total.cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """``(rule, n_failed, n_only)`` per rule of a policy: documents that fail it, and
    those that fail nothing else, which the policy would keep without the rule."""
    held = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    counts = rows.groupBy(held.alias("held")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(_BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("held", "n", F.inline(bits))
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.expr("CASE WHEN held & bit != 0 THEN n END")), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.expr("CASE WHEN held = bit THEN n END")), F.lit(0)).alias("n_only"),
    )
