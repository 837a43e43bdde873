"""Bounded labelled samples for fitting classifiers, drawn the same way on every run, and fitting away from the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.components import narrow


def fold(folds: int) -> Column:
    """The remainder of the CRC-32 of the doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def labelled(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """``(doc_id, y)`` outside the held-out fold; null labels are left out, of repeated doc_ids the largest label holds."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def draw(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, by a seeded hash of doc_id."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The drawn rows with their texts."""
    return narrow(docs.select("doc_id", "text"), ids, ["doc_id"])


def by_row(docs: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, *names: str) -> DataFrame:
    """``mapInPandas`` over ``(doc_id, *names)`` with the id as text, as pandas would turn a column of longs and nulls into floats.  ``run`` hands on ``doc_id``; ``schema`` tells the other columns."""
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *names).mapInPandas(run, f"doc_id string, {schema}")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def fit_apart(sample: DataFrame, train: Callable[[pd.DataFrame], bytes]) -> bytes:
    """Fit in one task on an executor: a bounded sample goes there and the pickled model comes back, so the driver holds neither rows nor arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        yield pd.DataFrame({"model": [train(pd.concat(parts, ignore_index=True) if parts else None)]})

    return bytes(sample.coalesce(1).mapInPandas(run, "model binary").first().model)
