"""Filters and per-cell measures of a long count matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Developmental phases.
PHASES = ["blastula", "gastrula", "neurula", "organogenesis", "fetal"]
#: Labels that count as missing, and the order of named stages.
MISSING = ["", "nan", "none", "<na>", "unknown"]
NAMED_STAGES = ["blastula", "gastrula", "neurula", "organogenesis"]


def cell_metrics(expr: DataFrame) -> DataFrame:
    """Number of expressed genes and total count of each cell."""
    return expr.groupBy("cell_id").agg(F.count_if(F.col("count") > 0).alias("n_genes"), F.sum("count").alias("total_counts"))


def qc_reasons(metrics: DataFrame, min_genes: int = 0, min_counts: float = 0, max_genes: int = 0, max_counts: float = 0) -> DataFrame:
    """Adds a flag for each threshold a cell fails, and ``kept``; bounds are inclusive and 0 switches one off."""
    fails = {
        "below_min_genes": (F.col("n_genes") < min_genes) if min_genes else F.lit(False),
        "below_min_counts": (F.col("total_counts") < min_counts) if min_counts else F.lit(False),
        "above_max_genes": (F.col("n_genes") > max_genes) if max_genes else F.lit(False),
        "above_max_counts": (F.col("total_counts") > max_counts) if max_counts else F.lit(False),
    }
    flagged = metrics.withColumns(fails)
    kept = F.lit(True)
    for name in fails:
        kept = kept & ~F.col(name)
    return flagged.withColumn("kept", kept)


def removal_counts(flagged: DataFrame) -> DataFrame:
    """Cells removed for each reason; a cell with two reasons counts under both."""
    names = [c for c in flagged.columns if c.startswith(("below_", "above_"))]
    return flagged.agg(*[F.count_if(c).alias(c) for c in names], F.count_if("kept").alias("kept"), F.count("*").alias("total"))


def outlier_cells(metrics: DataFrame, k: float) -> DataFrame:
    """Cells whose total lies strictly within ``k`` population standard deviations of the mean."""
    bounds = metrics.agg(F.avg("total_counts").alias("m"), F.stddev_pop("total_counts").alias("s"))  # one row
    near = (F.col("total_counts") > F.col("m") - k * F.col("s")) & (F.col("total_counts") < F.col("m") + k * F.col("s"))
    return metrics.crossJoin(F.broadcast(bounds)).where(near).drop("m", "s")


def raw_counts(expr: DataFrame, by: list[str]) -> DataFrame:
    """Whether all non-zero counts are within 1e-6 of an integer; a group without any is not raw."""
    whole = F.abs(F.col("count") - F.round("count")) < 1e-6
    nonzero = F.col("count") != 0
    return expr.groupBy(*by).agg((F.coalesce(F.bool_and(F.when(nonzero, whole)), F.lit(False))).alias("is_raw"), F.count_if(nonzero).alias("n_nonzero"))


def known(label: Column) -> Column:
    """Whether a label says anything."""
    return label.isNotNull() & ~F.lower(F.trim(label)).isin(MISSING)


def phase_gate(label: Column) -> Column:
    return F.when(label.isin(PHASES), label).when(~known(label), "<missing>").otherwise(F.concat(F.lit("unmapped:"), label))


def stage_key(label: Column) -> Column:
    """A sortable struct: named stages, then leading numbers (ties by text), then the rest."""
    place = F.array_position(F.array(*[F.lit(s) for s in NAMED_STAGES]), F.lower(F.trim(label)))
    number = F.regexp_extract(label, r"^\s*(\d+(?:\.\d+)?)", 1)
    named, numbered = place > 0, number != ""
    return F.struct(
        F.when(named, 0).when(numbered, 1).otherwise(2).alias("kind"),
        F.when(named, place.cast("double")).when(numbered, F.expr("1").cast("double") * F.try_to_number(number, F.lit("999999D999999")).cast("double")).otherwise(0.0).alias("n"),
        F.coalesce(label, F.lit("")).alias("text"),
    )


def label_map(label: Column, mapping: dict[str, str]) -> Column:
    """The mapped label where there is one, else the label; null stays null."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    return label if table is None else F.coalesce(F.try_element_at(table, label), label)


def min_class_size(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with ``least`` rows or more; the counts are aggregated first, so a large class is no window."""
    big = rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label)
    return rows.join(big, label, "left_semi")
