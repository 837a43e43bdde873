"""Tie-aware ranks, deciles, corrections and correlations as window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank, ties at their mean."""
    order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def midrank_decile(value: str, by: list[str]) -> Column:
    """Decile 0 to 9 of a value's tie block: its middle, not ntile."""
    order, ties, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value), Window.partitionBy(*by)
    middle = 2 * (F.rank().over(order) - 1) + F.count("*").over(ties)
    return F.least(F.lit(9), F.floor(10 * middle / (2 * F.count("*").over(whole)))).cast("long")


def top_k(rows: DataFrame, by: list[str], score: str, key: str, k: int, include_ties: bool) -> DataFrame:
    """The k best of each group by (-score, key); with ``include_ties`` all rows tied with the k-th."""
    order = Window.partitionBy(*by).orderBy(F.desc(score)) if include_ties else Window.partitionBy(*by).orderBy(F.desc(score), key)
    place = F.rank() if include_ties else F.row_number()
    return rows.withColumn("place", place.over(order).cast("long")).where(F.col("place") <= k)


def benjamini_hochberg(rows: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """Adds ``q``: the running minimum, from the largest p down, of p n / rank, at most 1."""
    order = Window.partitionBy(*by).orderBy(p, key)
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down))).drop("__r", "__n")


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate: null where either side is constant or there are fewer than two pairs; within [-1, 1]."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group, ties averaged; ``reason`` tells why it is null."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, by).alias("__x"), average_rank(y, by).alias("__y"))
    out = ranked.groupBy(*by).agg(pearson("__x", "__y").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("reason", F.when(F.col("n") < 2, "fewer_than_two_pairs").when(F.col("rho").isNull(), "constant_input"))


def z_score(observed: Column, mean: Column, sd: Column) -> Column:
    """Null where the null distribution has no spread."""
    return F.try_divide(observed - mean, sd)


def first_occurrence(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*by, key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prefix_offsets(rows: DataFrame, by: list[str], size: str, order: list[str]) -> DataFrame:
    """Adds ``start``: the sum of the sizes before a row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
