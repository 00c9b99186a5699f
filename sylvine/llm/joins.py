"""Joins that don't put a frequent key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE, PARTS = 256, 64


def frequent(many: DataFrame, on: list[str], total: int) -> list[int]:
    """Hashes of the keys of more than a SHARE-th of all `total` rows, SHARE at most."""
    counts = many.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > total / SHARE)
    return [r[0] for r in counts.select(F.xxhash64(*on).alias("k")).limit(SHARE).collect()]


def joined(many: DataFrame, one: DataFrame, on: list[str], by: list[str], total: int, how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """many (of `total` rows) joined with one, which has a row a key and in n how many rows of many have it; n drops out.

    Keys of more than a SHARE-th of all rows, SHARE at most, are cut in PARTS by a hash of `by`, and their row of one is
    given to every part. Only these keys' hashes go to the driver; where they are given in `hot`, one needs no n. No key may
    be null.
    """
    key = F.xxhash64(*on)
    if hot is None:
        hot = [r[0] for r in one.where(F.col("n") > total / SHARE).select(key.alias("k")).limit(SHARE).collect()]
        one = one.drop("n")
    if not hot:
        return many.join(one, on, how)
    part = F.when(key.isin(hot), F.pmod(F.xxhash64(*by), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    every = F.when(key.isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return many.withColumn("part", part).join(one.withColumn("part", F.explode(every)), [*on, "part"], how).drop("part")
