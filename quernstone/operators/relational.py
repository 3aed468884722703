"""Relational helpers: shards, batches, ranks within groups, samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order; Spark drops the rest before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Dense numbers from 0 in ``order``, without a global task: ranges are sorted apart and offset by the counts before them."""
    from ..functions.scratch import cut

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut(ranged.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_at", "_range", "_nth", "_before")


def shard_slices(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Balanced contiguous shards: the first ones have one row more where counts don't divide."""
    numbered = number_rows(df, order, "_row")
    base, more = F.floor(F.col("_all") / shards), F.col("_all") % shards
    both = numbered.crossJoin(df.agg(F.count("*").alias("_all")))  # one row
    at = F.when(F.col("_row") < more * (base + 1), F.floor(F.col("_row") / (base + 1))).otherwise(more + F.floor((F.col("_row") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    return both.withColumn("shard", at.cast("int")).drop("_row", "_all")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Fixed-size batches of rows in order."""
    return number_rows(df, order, "_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")


def hash_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in the order of a seeded hash of their key: a sample without replacement, the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k)


def rank_slice(df: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    """Every ``world``-th row in order from the ``rank``-th."""
    return number_rows(df, order, "_row").where(F.col("_row") % world == rank).drop("_row")


def fraction(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """The first ``ceil(share * n)`` rows in order."""
    return df.orderBy(*order).limit(-int(-(df.count() * share) // 1))
