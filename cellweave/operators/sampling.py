"""Splits, cohorts and samples in seeded hash order: the same rows on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *parts: Column) -> Column:
    """SHA-256 of the seed and the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def assign_splits(units: DataFrame, seed: int = 0) -> DataFrame:
    """``units(species, embryo_id, train_only)`` -> split and reason of each embryo.

    Train-only embryos train; so do all of a species with fewer than three others.  Else the first
    max(1, round(0.2 n)) in hash order validate, the next max(1, round(0.1 n)) are held out (halves round to even).
    """
    free = units.where("not train_only")
    n = free.groupBy("species").agg(F.count("*").alias("n"))
    order = Window.partitionBy("species").orderBy(hash_order(seed, F.col("species"), F.col("embryo_id")))
    ranked = free.withColumn("r", F.row_number().over(order)).join(n, "species")
    val = F.greatest(F.lit(1), F.bround(F.col("n") * 0.2)).cast("int")
    hold = F.greatest(F.lit(1), F.bround(F.col("n") * 0.1)).cast("int")
    split = F.when(F.col("n") < 3, "train").when(F.col("r") <= val, "validation").when(F.col("r") <= val + hold, "holdout").otherwise("train")
    reason = F.when(F.col("n") < 3, "insufficient_embryos").otherwise("assigned")
    dealt = ranked.select("species", "embryo_id", split.alias("split"), reason.alias("reason"))
    fixed = units.where("train_only").select("species", "embryo_id", F.lit("train").alias("split"), F.lit("train_only").alias("reason"))
    return dealt.unionByName(fixed)


def stratified_cap(rows: DataFrame, strata: list[str], key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows: an equal share of each stratum in hash order, then the rest of the cap by hash.

    The number of strata is aggregated; each stratum is ranked on its own.
    """
    groups = rows.select(*strata).distinct().count()
    share = max(1, cap // max(1, groups))
    order = Window.partitionBy(*strata).orderBy(hash_order(seed, F.col(key)))
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__h", hash_order(seed, F.col(key)))
    first = ranked.withColumn("__late", (F.col("__r") > share).cast("int"))
    return first.orderBy("__late", "__h").limit(cap).drop("__r", "__h", "__late")


def dhondt_cohort(groups: DataFrame, size: str, key: list[str], slots: int) -> DataFrame:
    """One slot a group, the others to the largest size / (slots + 1): all quotients ranked at once."""
    n = groups.count()
    quotients = groups.withColumn("__k", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.col(size).cast("int"), F.lit(slots))))))
    ranked = quotients.where(F.col("__k") <= F.col(size)).withColumn("__q", F.col(size) / F.col("__k")).orderBy(F.desc("__q"), *key, "__k").limit(max(0, slots - n))
    extra = ranked.groupBy(*key).agg(F.count("*").alias("more"))
    return groups.join(extra, key, "left").withColumn("slots", (1 + F.coalesce("more", F.lit(0))).cast("long")).drop("more")


def hash_selection(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of each group in hash order."""
    order = Window.partitionBy(*by).orderBy(hash_order(seed, *[F.col(c) for c in by], F.col(key)))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)
