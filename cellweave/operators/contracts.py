"""Contracts between tables: manifests, identity sidecars, coordinates, readiness and published results, as tables of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(rules: dict[str, Column]) -> Column:
    """All rules that a row breaks, in order, as an array: nothing stops at the first.  A null rule is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def dataset_rules(kinds: list[str]) -> dict[str, Column]:
    """Rules of a manifest's dataset ``(dataset_type, section_id, species, sha256)``: null species and digests are allowed, blank ones are not."""
    blank = lambda c: F.trim(c) == ""
    return {
        "unknown_type": ~F.coalesce(F.col("dataset_type").isin(kinds), F.lit(False)),
        "spatial_without_section": (F.col("dataset_type") == "spatial") & (F.coalesce("section_id", F.lit("")) == ""),
        "blank_species": blank("species"),
        "bad_digest": ~F.rlike("sha256", F.lit("^[0-9a-f]{64}$")),
    }


def sidecar_findings(cells: DataFrame, sidecar: DataFrame, same: list[str]) -> DataFrame:
    """``(sample, embryo_id, problem)``: cells joined with a sidecar by ``sample``.

    A sample that the sidecar repeats, a removed one, an embryo id that is no number, a differing field of ``same``, or a cell without a
    row.  The sidecar's ``embryo_id`` is text and ``removed`` boolean; its rows without a cell are not looked at.  Repeats are
    counted by aggregation before the join, so it stays one row a cell.
    """
    kept = sidecar.groupBy("sample").agg(F.count("*").alias("__n"), F.max("removed").alias("removed"), F.min("embryo_id").alias("embryo_id"), *[F.min(c).alias(f"__{c}") for c in same])
    met = cells.select("sample", *same).join(kept, "sample", "left")
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same], F.lit(False))
    problem = (
        F.when(F.col("__n").isNull(), "unmatched").when(F.col("__n") > 1, "repeated").when(differs, "field_differs")
        .when(F.coalesce("removed", F.lit(False)), "removed").when(~F.rlike(F.coalesce("embryo_id", F.lit("")), F.lit("^[0-9]+$")), "bad_embryo")
    )
    return met.select("sample", F.when(problem.isNull(), F.concat(F.lit("embryo_"), "embryo_id")).alias("embryo_id"), problem.alias("problem"))


def inconsistent(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, fields...)``: keys with more than one value of a field, with the number of values of each."""
    counted = rows.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in fields])
    return counted.where(reduce(lambda x, y: x | y, [F.col(c) > 1 for c in fields]))


def coordinate_findings(points: DataFrame, section: str) -> DataFrame:
    """``(section, n, nonfinite, disagree)`` of ``(x, y, old_x, old_y)``: coordinates that are no numbers, and those unlike the ones that were there (null: none were)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    off = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.col(b).isNotNull())
    return points.groupBy(section).agg(F.count("*").alias("n"), F.count_if(bad("x") | bad("y")).alias("nonfinite"), F.count_if(off("x", "old_x") | off("y", "old_y")).alias("disagree"))


def canonical_repeats(rows: DataFrame, by: list[str], gene: str, canonical: Column) -> DataFrame:
    """``(by..., canonical, n)``: identities that several listed genes share once written in their canonical form."""
    return rows.select(*by, F.col(gene).alias("__g"), canonical.alias("canonical")).groupBy(*by, "canonical").agg(F.count("*").alias("n")).where("n > 1")


def readiness(required: DataFrame, training: DataFrame, mapped: DataFrame, draws: DataFrame) -> DataFrame:
    """``(species, rows, genes, status, reasons)`` of the species that are required.

    ``training(species, n)``, ``mapped(species, genes, positive)`` (vocabulary genes and whether any has a count) and
    ``draws(species, draws)`` have at most a row a species; a missing one counts as none.
    """
    met = required.join(training, "species", "left").join(mapped, "species", "left").join(draws, "species", "left").fillna(0, ["n", "genes", "draws"])
    why = problems({
        "no_post_qc_training_observations": F.col("n") == 0,
        "no_prepared_genes_in_checkpoint_vocabulary": F.col("genes") == 0,
        "no_positive_vocabulary_mapped_expression": (F.col("genes") > 0) & ~F.coalesce("positive", F.lit(False)),
        "no_projected_sampler_exposure": F.col("draws") == 0,
    })
    return met.select("species", F.col("n").alias("rows"), "genes", F.when(F.size(why) > 0, "blocked").otherwise("prepared_ready_training_unverified").alias("status"), F.array_join(why, ";").alias("reasons"))


def published_differences(published: DataFrame, again: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``(key..., problem)`` where a published table and its recomputation differ: a row of one only, or a number off by more than ``tolerance`` of it."""
    right = again.select(*key, F.lit(True).alias("__again"), *[F.col(v).alias(f"__{v}") for v in values])
    met = published.select(*key, F.lit(True).alias("__was"), *values).join(right, key, "full")

    def off(v: str) -> Column:
        a, b = F.col(v), F.col(f"__{v}")
        return ~F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))

    problem = F.when(F.col("__was").isNull(), "not_published").when(F.col("__again").isNull(), "not_recomputed").when(reduce(lambda x, y: x | y, map(off, values)), "differs")
    return met.select(*key, problem.alias("problem")).where("problem is not null")


def replay_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either table, repeats counted, that the other lacks, with ``side``: empty where a replay equals its original."""
    names = first.columns
    both = first.withColumn("__v", F.lit(1)).unionByName(second.select(*names).withColumn("__v", F.lit(-1)))
    # one aggregation instead of two set differences
    net = both.groupBy(*names).agg(F.sum("__v").alias("__v")).where("__v <> 0")
    return net.select(*names, F.when(F.col("__v") > 0, "first").otherwise("second").alias("side"), F.abs("__v").alias("times"))


def top_origin(published: DataFrame, scores: DataFrame, by: list[str], key: str, score: str, k: int) -> DataFrame:
    """``(by..., listed, found, same)``: whether each published list is the set of the ``k`` best by (-score, key)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    best = scores.withColumn("__r", place).where(F.col("__r") <= k).select(*by, key, F.lit(True).alias("__best"))
    met = published.select(*by, key, F.lit(True).alias("__listed")).distinct().join(best, [*by, key], "full")
    both = F.count_if(F.col("__listed") & F.col("__best"))
    return met.groupBy(*by).agg(F.count("__listed").alias("listed"), both.alias("found"), ((F.count("*") == both)).alias("same"))


def file_rows(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """``(index, file, row)`` of indexes into files ``(file, n)`` laid end to end in order of ``file``; null outside of all.

    The starts are one row with as many entries as there are files; an index counts those at or before it.  Empty files have no rows.
    """
    starts = files.where("n > 0").withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = starts.agg(F.sort_array(F.collect_list(F.struct("start", "file", "n"))).alias("s"))
    met = indexes.select("index").join(F.broadcast(held)).withColumn("at", F.try_element_at("s", F.nullif(F.expr("size(filter(s, x -> x.start <= index))"), F.lit(0))))
    inside = F.col("index") - F.col("at.start") < F.col("at.n")
    return met.select("index", F.when(inside, F.col("at.file")).alias("file"), F.when(inside, F.col("index") - F.col("at.start")).alias("row"))


def clean_sequence(sequence: Column, unknown: str = "<unk>") -> Column:
    """A protein sequence with every stop sign written as the unknown token."""
    return F.replace(sequence, F.lit("*"), F.lit(unknown))


def vocabulary(text: Column) -> Column:
    """A JSON object of token to index as rows' ``map<string,long>``; null for text that is no object."""
    return F.from_json(text, "map<string,long>")
