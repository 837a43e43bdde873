"""Group-and-collapse, two-level means and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse_duplicates(expr: DataFrame) -> DataFrame:
    """One row a (cell, gene): counts summed, in order of first occurrence; ``n_collapsed`` tells how many rows it was."""
    return expr.groupBy("cell_id", "gene_id").agg(F.sum("count").alias("count"), F.min("pos").alias("pos"), F.count("*").alias("n_collapsed"))


def drop_later_duplicates(expr: DataFrame) -> DataFrame:
    """One row a (cell, gene): the first by position stays, of rows at one position that of the smallest count."""
    first = expr.groupBy("cell_id", "gene_id").agg(F.min(F.struct("pos", "count")).alias("f"))
    return first.select("cell_id", "gene_id", "f.pos", "f.count")


def log_normalised(expr: DataFrame, target: float = 10_000.0) -> DataFrame:
    """log1p(count / cell total * target); the total is over all genes given, an empty cell has 0."""
    total = F.sum("count").over(Window.partitionBy("cell_id"))
    return expr.withColumn("x", F.log1p(F.coalesce(F.try_divide(F.col("count"), total), F.lit(0.0)) * target))


def embryo_statistics(expr: DataFrame, obs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of log-normalised counts and detected cells for each (embryo, gene), with the embryo's number of cells."""
    cells = obs.groupBy(*by, "embryo_id").agg(F.count("*").alias("n_cells"))
    found = log_normalised(expr).join(obs.select(*by, "embryo_id", "cell_id"), "cell_id")
    sums = found.groupBy(*by, "embryo_id", "gene_id").agg(F.sum("x").alias("log_sum"), F.count_if(F.col("count") > 0).alias("detected"))
    return sums.join(cells, [*by, "embryo_id"])


def pooled_metrics(statistics: DataFrame, obs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and dropout of each gene over all cells of a group, cells without the gene counted."""
    cells = obs.groupBy(*by).agg(F.count("*").alias("n_cells"))
    genes = statistics.groupBy(*by, "gene_id").agg(F.sum("log_sum").alias("s"), F.sum("detected").alias("d"))
    return genes.join(cells, by).select(*by, "gene_id", (F.col("s") / F.col("n_cells")).alias("mean_log1p"), (1 - F.col("d") / F.col("n_cells")).alias("dropout"))


def balanced_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over cells in each embryo, then over embryos; null values are unavailable, not zero."""
    embryo = rows.where(F.col(value).isNotNull()).groupBy(*by, "embryo_id").agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    return embryo.groupBy(*by).agg(F.avg("m").alias("mean"), F.sum("n").alias("n_cells"), F.count("*").alias("n_embryos"))


def weighted_mean(embryo_means: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Embryo means weighted by the whole-number multiplicities of a draw."""
    joined = embryo_means.join(weights, "embryo_id")
    return joined.groupBy(*by).agg(F.try_divide(F.sum(F.col("m") * F.col("w")), F.sum("w")).alias("mean"), F.sum("w").cast("long").alias("weight"))


def coverage(obs: DataFrame, by: list[str], phases: list[str], floor: int = 3) -> DataFrame:
    """Cells and embryos of each group and its reporting tier."""
    counted = obs.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_distinct("embryo_id").alias("n_embryos"))
    tier = F.when(~F.col("phase").isin(phases), "overall_summary_only").when(F.col("n_embryos") >= floor, "primary").otherwise("descriptive")
    return counted.withColumn("tier", tier)


def dependency_violations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: empty where the value depends on the key."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and row shares of each (truth, predicted)."""
    counts = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Unweighted mean of the classes' F1; a class is one seen on either side."""
    t = rows.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("t"), F.count_if(F.col(truth) == F.col(predicted)).alias("hit"))
    p = rows.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("p"))
    both = t.join(p, "c", "full").fillna(0, ["t", "p", "hit"])
    return both.agg(F.avg(2.0 * F.col("hit") / (F.col("t") + F.col("p"))).alias("macro_f1"), F.count("*").alias("n_classes"))


def paired_differences(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean, median and signs of a - b."""
    d = rows.select(*by, (F.col(a) - F.col(b)).alias("d"))
    return d.groupBy(*by).agg(
        F.avg("d").alias("mean"), F.median("d").alias("median"), F.count_if(F.col("d") > 0).alias("n_pos"), F.count_if(F.col("d") < 0).alias("n_neg"), F.count_if(F.col("d") == 0).alias("n_zero")
    )
