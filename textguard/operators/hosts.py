"""Which hosts are watched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.rules.targets import DOMAINS


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def parents(host: Column) -> Column:
    """The host and its parent domains of at least two labels."""
    labels = F.split(host, "\\.")
    longer = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.array_distinct(F.array_append(longer, host))


def is_target(host: Column, domains: Sequence[str] = DOMAINS) -> Column:
    """Whether a host is watched; a list of domains needs no join."""
    return F.coalesce(F.exists(parents(host), lambda p: p.isin(*domains)), F.lit(False))


def watched(df: DataFrame, host: str, targets: DataFrame) -> DataFrame:
    """Rows whose host is watched, for a table of target domains of any size.

    Each host is judged once, however many rows it has.
    """
    domains = df.select(host).distinct().withColumn("domain", F.explode(parents(F.col(host))))
    hit = domains.join(targets.select("domain"), "domain", "left_semi").select(host).distinct()
    return df.join(hit, host, "left_semi")
