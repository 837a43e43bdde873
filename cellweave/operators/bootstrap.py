"""Embryo-block bootstrap from precomputed sufficient statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.aggregates import weighted_mean

DRAWS = 2000
SEED = 20_260_930
#: Draws in a task, and the bytes of means that all tasks may hold.
RUN, ARRAYS = 100, 16 << 20


def draw_weights(embryos: DataFrame, by: list[str], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """``(draw, *by, embryo_id, w)``: how often each embryo is drawn; a draw takes as many embryos of a group as it has, with replacement.

    An embryo's place in its group is one slot of every draw; a seeded hash of draw, group and slot names the place that is
    taken.  Slots are made and counted on the executors.
    """
    group = Window.partitionBy(*by)
    placed = embryos.select(*by, "embryo_id").distinct()
    placed = placed.withColumns({"slot": F.row_number().over(group.orderBy("embryo_id")) - 1, "n": F.count("*").over(group)})
    slots = placed.select(*by, "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    taken = slots.select("draw", *by, F.pmod(F.xxhash64(F.lit(seed), "draw", *by, "slot"), "n").cast("int").alias("slot"))
    counted = taken.groupBy("draw", *by, "slot").agg(F.count("*").cast("int").alias("w"))
    return counted.join(placed.drop("n"), [*by, "slot"]).select("draw", *by, "embryo_id", "w")


def _hashed(slots: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of int ``slots`` (columns) after the columns whose hashes are ``seeds`` (rows)."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seeds.astype(np.int64).view(np.uint64) + p5 + np.uint64(4))[:, None] ^ (slots.astype(np.uint64) * p1)[None, :]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def drawn_means(statistics: DataFrame, by: list[str], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """``(draw, *by, drawn)``: the group means of the draws of ``draw_weights``, for statistics of one row an embryo of a group.

    A group's means are one array in the order of its slots, so a slot of a draw is a hash and a look-up in an array, and only
    a row for each group and run of draws leaves a task.  Arrays of up to ``ARRAYS`` bytes in all go to all tasks; larger
    ones are dealt out by group and run.
    """
    held = statistics.dropna(subset=[*by, "embryo_id"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("embryo_id", "m"))).alias("x"))
    held = held.select(*by, F.transform("x", lambda e: F.coalesce(e["m"], F.lit(0.0)).cast("double")).alias("ms"))
    runs = -(-draws // RUN)
    if statistics.count() * 8 <= ARRAYS:
        dealt = statistics.sparkSession.range(runs).withColumnRenamed("id", "run").repartition(runs, "run").crossJoin(F.broadcast(held))
    else:
        dealt = held.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition(*by, "run")
    some = F.sequence((F.col("run") * RUN).cast("int"), F.least(F.lit(draws), (F.col("run") + 1) * RUN).cast("int") - 1)
    dealt = dealt.withColumn("draw", some).withColumn("seed", F.transform("draw", lambda d: F.xxhash64(F.lit(seed), d, *by))).select(*by, "draw", "seed", "ms")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seeds, ms in zip(batch.column("seed"), batch.column("ms"), strict=True):
                seeds, ms = seeds.values.to_numpy(), ms.values.to_numpy()
                slots, step = np.arange(len(ms)), max(1, (1 << 18) // len(ms))
                out.append(np.concatenate([ms[_hashed(slots, seeds[i : i + step]) % len(ms)].mean(axis=1) for i in range(0, len(seeds), step)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("draw"), pa.array(out, pa.list_(pa.float64()))], names=[*by, "draw", "drawn"])

    kept = T.StructType([*(dealt.schema[c] for c in by), dealt.schema["draw"], T.StructField("drawn", T.ArrayType(T.DoubleType()))])
    told = dealt.mapInArrow(means, kept)
    return told.select(*by, F.inline(F.arrays_zip("draw", "drawn"))).select("draw", *by, "drawn")


def interval(statistics: DataFrame, weights: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Nearest-rank half-width of |draw mean - mean| around each group's mean; all draws are one join, not a loop."""
    drawn = weighted_mean(statistics, weights.drop(*by), ["draw", *by]).select("draw", *by, F.col("mean").alias("drawn"))
    return interval_of(statistics, drawn, by, level)


def interval_of(statistics: DataFrame, drawn: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """``interval`` from the means of the draws, ``drawn(draw, *by, drawn)``."""
    observed = statistics.groupBy(*by).agg(F.avg("m").alias("mean"))
    off = drawn.join(observed, by).withColumn("off", F.abs(F.col("drawn") - F.col("mean")))
    half = off.groupBy(*by).agg(F.first("mean").alias("mean"), F.expr(f"percentile_disc({level}) within group (order by off)").alias("half_width"), F.count("*").alias("n_draws"))
    return half.withColumns({"low": F.col("mean") - F.col("half_width"), "high": F.col("mean") + F.col("half_width")})
