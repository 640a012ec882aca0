"""Joins that stay even when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than 1/HOT of all rows is hot, so there are fewer than HOT.
HOT = 1000
SALTS = 64


def salted_join(left: DataFrame, right: DataFrame, key: str, *spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` with hot left keys spread over ``salts`` tasks, by ``spread_by``.

    Hot keys are counted first (partial counts only are shuffled). The list of
    hot keys has fewer than ``HOT`` entries, whatever the data, and is broadcast.
    Right rows of hot keys are copied once per salt.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("t"))
    hot = counts.withColumn("__t", total.scalar()).where(F.col("__n") * HOT > F.col("__t")).select(
        key, F.lit(True).alias("__hot")
    )
    hot = F.broadcast(hot)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    salted = left.join(hot, key, "left").withColumn("__salt", salt).drop("__hot")
    copied = right.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(copied, [key, "__salt"]).drop("__salt")
