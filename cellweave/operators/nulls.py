"""Null distributions from peers measured in the same cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.aggregates import balanced_mean


def peer_scores(facts: DataFrame, bins: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    """Scores of peers in the cells where a focal gene is scored: same bin, another gene.

    ``facts(embryo_id, cell_id, gene_id, score)``; only the focal genes asked for are expanded, and the join is an
    equi-join on (cell, bin).
    """
    scored = facts.where(F.col("score").isNotNull()).join(bins, "gene_id")
    asked = scored if focal is None else scored.join(focal, "gene_id", "left_semi")
    f = asked.select(F.col("gene_id").alias("focal"), "embryo_id", "cell_id", "bin")
    p = scored.select(F.col("gene_id").alias("peer"), "cell_id", "bin", "score")
    return f.join(p, ["cell_id", "bin"]).where("focal <> peer")


def matched_peer_z(facts: DataFrame, bins: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    """z of each focal gene against the peers of its bin that are scored in exactly its cells (relational division).

    ``reason`` is the first step that fails; the null mean and standard deviation (sample) are over peers'
    balanced means.
    """
    wanted = facts if focal is None else facts.join(focal, "gene_id", "left_semi")
    observed = balanced_mean(wanted, ["gene_id"], "score").select(F.col("gene_id").alias("focal"), F.col("mean").alias("observed"), "n_cells", "n_embryos")
    per_embryo = peer_scores(facts, bins, focal).groupBy("focal", "peer", "embryo_id").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    peers = per_embryo.groupBy("focal", "peer").agg(F.avg("m").alias("mean"), F.sum("n").alias("covered"))
    judged = peers.join(observed.select("focal", "n_cells"), "focal").withColumn("whole", F.col("covered") == F.col("n_cells"))
    null = judged.groupBy("focal").agg(
        F.count("*").alias("candidates"), F.count_if("whole").alias("matched"), F.avg(F.when(F.col("whole"), F.col("mean"))).alias("null_mean"), F.stddev_samp(F.when(F.col("whole"), F.col("mean"))).alias("null_sd")
    )
    out = observed.join(null, "focal", "left").fillna(0, ["candidates", "matched"])
    reason = F.when(F.col("matched") < 2, "fewer_than_two_matched_peers").when(F.coalesce(F.col("null_sd"), F.lit(0.0)) < 1e-12, "zero_or_nonfinite_null_variance")
    out = out.withColumn("reason", reason)
    return out.withColumn("z", F.when(F.col("reason").isNull(), F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd"))))


def measured_zero(facts: DataFrame, bins: DataFrame) -> DataFrame:
    """``(focal, peer, cell_id, state, value)`` for every peer of a focal gene's bin in the cells where the focal gene is scored.

    ``facts(cell_id, gene_id, score)`` has a row for each gene expressed in a cell.  A peer that is scored there has its score; one
    that is expressed but not scored is unavailable; one that is not expressed is a measured zero.  Rows follow the cells of a focal
    gene times the members of its bin, which merging keeps bounded.
    """
    asked = facts.where(F.col("score").isNotNull()).join(bins, "gene_id").select(F.col("gene_id").alias("focal"), "cell_id", "bin")
    peers = asked.join(bins.select(F.col("gene_id").alias("peer"), "bin"), "bin").where("focal <> peer")
    held = facts.select(F.col("gene_id").alias("peer"), "cell_id", "score", F.lit(True).alias("expressed"))
    met = peers.join(held, ["peer", "cell_id"], "left")
    state = F.when(F.col("score").isNotNull(), "scored").when(F.col("expressed"), "unavailable").otherwise("zero")
    return met.select("focal", "peer", "cell_id", state.alias("state"), F.when(state == "scored", F.col("score")).when(state == "zero", 0.0).alias("value"))
