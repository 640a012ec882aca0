"""Column expressions over text: normal forms, lengths, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def markless(text: Column) -> Column:
    """Text safe to mark with ``MARK``: an own U+0001 becomes U+0002."""
    return F.when(text.contains(MARK), F.translate(text, MARK, "\u0002")).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case with the two characters that fold to ASCII letters replaced."""
    rare = text.contains("ſ") | text.contains("\u212a")
    return F.lower(F.when(rare, F.translate(text, "ſ\u212a", "sk")).otherwise(text))


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut(value: Column, n: int) -> Column:
    """First ``n`` characters and an ellipsis when the value is longer."""
    return F.when(F.length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("..."))).otherwise(value)


def token_estimate(text: Column) -> Column:
    """Words on space, tab and line feed, a token being three quarters of one."""
    words = F.size(F.regexp_extract_all(text, F.lit("[^ \\n\\t]+"), F.lit(0)))
    return F.floor(words / F.lit(0.75)).cast("int")


def lowered(text: Column) -> Column:
    """Lower case, letter by letter: the dotted capital I gives one character."""
    return F.lower(F.when(text.contains("İ"), F.translate(text, "İ", "i")).otherwise(text))


def normalized(text: Column, limit: int | None = None) -> Column:
    """Lower case, blanks trimmed and collapsed; cut to ``limit`` characters if given."""
    blanks = r"[\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    whole = F.trim(F.regexp_replace(lowered(text), blanks, " "))
    return whole if limit is None else F.left(whole, F.lit(limit))


def encoded(text: Column, limit: int | None = None) -> Column:
    """Character ids of the normalized text: ASCII code, 1 unknown; padded with 0 up to
    ``limit`` if given."""
    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    ids = F.transform(
        chars,
        lambda c: F.when((F.octet_length(c) == 1) & F.ascii(c).between(32, 126), F.ascii(c)).otherwise(F.lit(1)),
    )
    return ids if limit is None else F.concat(ids, F.array_repeat(F.lit(0), F.lit(limit) - F.size(ids)))


def decoded(ids: Column) -> Column:
    """Text of character ids; unknown ones become U+FFFD, padding disappears."""
    known = F.filter(ids, lambda i: (i == 1) | i.between(32, 126))
    return F.array_join(F.transform(known, lambda i: F.when(i == 1, F.lit("�")).otherwise(F.char(i))), "")


def fingerprint(text: Column) -> Column:
    """First 16 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def truncated_prefix(text: Column, cap_bytes: int) -> Column:
    """The leading whole characters that fit in ``cap_bytes`` bytes."""
    head = F.substring(F.encode(text, "UTF-8"), 1, cap_bytes)
    # Continuation bytes of a character cut in half are dropped with their lead.
    tail = F.length(F.regexp_extract(F.hex(F.substring(F.encode(text, "UTF-8"), cap_bytes + 1, 1)), "^[89AB]", 0))
    lead = F.length(F.regexp_extract(F.hex(F.substring(head, cap_bytes - 3, 4)), "([C-F].(?:[89AB].){0,3})$", 1)) / 2
    keep = F.when(tail > 0, F.lit(cap_bytes) - lead.cast("int")).otherwise(F.lit(cap_bytes))
    whole = F.decode(F.substr(head, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(text) > cap_bytes, whole).otherwise(text)
