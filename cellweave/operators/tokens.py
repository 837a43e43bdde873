"""Vocabularies and tokenised cell sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def positions(tokens: DataFrame, specials: list[str]) -> DataFrame:
    """``(token, place)`` -> ``(token, position)``: special tokens first in the order given, then each other token once, by first place."""
    first = tokens.where(F.col("token").isNotNull() & ~F.col("token").isin(specials)).groupBy("token").agg(F.min("place").alias("place"))
    ranked = first.select("token", (F.row_number().over(Window.orderBy("place", "token")) - 1 + len(specials)).cast("long").alias("position"))
    fixed = [F.struct(F.lit(t).alias("token"), F.lit(i).cast("long").alias("position")) for i, t in enumerate(specials)]
    return ranked.union(ranked.sparkSession.range(1).select(F.inline(F.array(*fixed)))) if fixed else ranked


def lookup(rows: DataFrame, vocab: DataFrame, column: str, unknown: int) -> DataFrame:
    """Adds ``position``: that of the row's token, ``unknown`` where the vocabulary has none."""
    named = vocab.select(F.col("token").alias("__t"), "position")
    return rows.join(named, F.col(column) == F.col("__t"), "left").withColumn("position", F.coalesce("position", F.lit(unknown).cast("long"))).drop("__t")


def sentences(expr: DataFrame, length: int, clip_to: float, pad: int, by_count: bool = False) -> DataFrame:
    """``(cell_id, token, pos, count)`` -> a row a cell: ``tokens`` and clipped ``counts`` of ``length`` entries, and ``mask`` (1: padding).

    Expressed genes stand first, in order of position or of falling count; genes of count 0 follow.  What is beyond ``length`` is cut.
    """
    zero = (F.col("count") <= 0).cast("int")
    rank = F.when(F.col("count") > 0, -F.col("count")).otherwise(0.0) if by_count else F.lit(0.0)
    entry = F.struct(zero.alias("z"), rank.alias("r"), "pos", "token", clip(F.col("count"), 0.0, clip_to).alias("c"))
    cells = expr.groupBy("cell_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, length).alias("e"))
    short = F.lit(length) - F.size("e")
    return cells.select(
        "cell_id",
        F.concat(F.col("e.token"), F.array_repeat(F.lit(pad).cast("long"), short)).alias("tokens"),
        F.concat(F.col("e.c"), F.array_repeat(F.lit(0.0), short)).alias("counts"),
        F.concat(F.array_repeat(F.lit(0), F.size("e")), F.array_repeat(F.lit(1), short)).alias("mask"),
    )
