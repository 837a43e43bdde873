"""Sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write once as Parquet, partitioned if asked; an existing path is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def gene_major(df: DataFrame, path: str, partitions: int) -> None:
    """A transposed index: range-partitioned and sorted by gene, so a gene's cells are read from few row groups."""
    df.repartitionByRange(partitions, "gene_id").sortWithinPartitions("gene_id", "cell_id").write.mode("errorifexists").parquet(path)
