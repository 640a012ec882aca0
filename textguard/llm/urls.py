"""URL filter: rules on host and path, then a list of blocked canonical URLs.

The list becomes a blocked Bloom filter of fixed size, which is broadcast. Rows that
it lets pass go to an exact hash join with the list; that join takes false positives
out. All other rows are not shuffled at all.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is not listed. Repeated rows are judged alike. Duplicate and null entries of
the list count once and not at all. Other columns pass unchanged; columns named
``host``, ``path``, ``rule``, ``listed`` or ``verdict`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm import bloom

#: (verdict, host, path): a rule fits the host, its subdomains, and paths that start so.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Host labels whose pages make up the list of the query.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "(?s)^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, ``m.`` or default port, path without a closing
    slash, and the query without tracking parameters. Null without ``://``."""
    host = F.regexp_replace(host_of(url), "^(www|m)\\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_after(url), "(?s)^[^?#]*[?]([^#]*)", 1)
    args = F.regexp_replace(F.concat(F.lit("&"), query), "&((utm_[a-z]+|ref)(=[^&]*)?)?(?=&|$)", "")
    args = F.regexp_replace(args, "^&", "?")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, args))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        on = F.concat(F.lit("."), host).endswith(f".{name}") & path.startswith(start)
        fit = F.when(on, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def listed_urls(pages: DataFrame, url: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """``(url)``: canonical URLs of pages on hosts with one of the labels."""
    host = F.concat(F.lit("."), host_of(F.col(url)), F.lit("."))
    on = F.lit(False)
    for label in labels:
        on = on | F.contains(host, F.lit(f".{label}."))
    return pages.where(on).select(canonical(F.col(url)).alias("url")).distinct()


def _judged(df: DataFrame, listed: Column) -> DataFrame:
    return df.withColumn("listed", listed).withColumn(
        "verdict", F.coalesce("_fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    )


def filter_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, log2_blocks: int = bloom.LOG2_BLOCKS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict``; ``listed``
    is a table of canonical URLs in the column ``url``."""
    made = ("host", "path", "rule", "listed", "verdict")
    own = [c for c in pages.columns if c not in made]
    target = F.col(url)
    rows = pages.select(*own).withColumns({"host": host_of(target), "path": path_of(target), "_url": canonical(target)})
    rows = rows.withColumns({"_fit": rule_of(F.col("host"), F.col("path"), rules), "_key": F.xxhash64("_url")})
    keyed = listed.where("url IS NOT NULL").select(F.col("url").alias("_url")).distinct().withColumn("_key", F.xxhash64("_url"))
    marked = bloom.with_maybe(rows, "_key", bloom.bloom_table(keyed, "_key", log2_blocks), log2_blocks)
    clear = _judged(marked.where(~F.col("_maybe")), F.lit(False))
    exact = keyed.select("_key", "_url", F.lit(True).alias("_on"))
    possible = marked.where("_maybe").join(exact, ["_key", "_url"], "left")
    columns = [*own, "host", "path", F.col("_fit.rule").alias("rule"), "listed", "verdict"]
    hits = _judged(possible, F.coalesce("_on", F.lit(False)))
    return clear.select(*columns).unionByName(hits.select(*columns))
