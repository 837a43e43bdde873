"""Likelihoods, deletion impacts, peer support and redrawn null distributions over long tables of cells and genes."""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.nulls import measured_zero
from cellweave.operators.ranking import average_rank, pearson


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, less the logarithm of the eight factors between."""
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - inverse / 1680.0) * inverse) * inverse) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + series - F.log(reduce(lambda p, i: p * (x + float(i)), range(1, 8), x))


def ztp_loss(mu: Column, count: Column, eps: float = 1e-5, most: float = 1e10) -> Column:
    """Negative log-likelihood of a zero-truncated Poisson count, with the normaliser's softplus form, which is never below 0."""
    rate, c = mu + eps, F.greatest(F.lit(eps), F.least(F.lit(most), count))
    return F.greatest(F.lit(0.0), rate - F.log1p(F.exp(-rate))) - c * F.log(rate) + log_gamma(c + 1.0)


def cell_loss(rows: DataFrame, by: str, mu: str, count: str, masked: str) -> DataFrame:
    """``(by, n, loss)``: mean loss over the unmasked genes of each cell; null where all are masked."""
    loss = F.when(~F.col(masked), ztp_loss(F.col(mu), F.col(count)))
    return rows.groupBy(by).agg(F.count(loss).alias("n"), F.avg(loss).alias("loss"))


def deletion_impact(whole: DataFrame, deleted: DataFrame) -> DataFrame:
    """``(cell_id, at, n, bits, reason)``: mean loss of log-probability, in bits, over the genes after a deleted position.

    ``whole(cell_id, pos, gene_id, logp)`` has a cell's own log-probabilities and ``deleted(cell_id, at, gene_id, logp)`` those
    without the gene at ``at``.  A target is a gene of both whose place in the cell is after ``at``; a deletion without any has null.
    """
    after = whole.select("cell_id", "pos", "gene_id", F.col("logp").alias("had"))
    met = deleted.join(after, ["cell_id", "gene_id"], "left")
    drop = F.when(F.col("pos") > F.col("at"), (F.col("had") - F.col("logp")) / log(2))
    out = met.groupBy("cell_id", "at").agg(F.count(drop).alias("n"), F.avg(drop).alias("bits"))
    return out.withColumn("reason", F.when(F.col("n") == 0, "no_matched_targets"))


def token_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(cell_id, gene_id, problem)`` where two sets of ``(cell_id, gene_id, pos)`` differ: missing, extra, repeated or misplaced.

    ``actual`` may repeat a key; ``expected`` may not.
    """
    got = actual.groupBy("cell_id", "gene_id").agg(F.count("*").alias("times"), F.min("pos").alias("got"))
    met = expected.join(got, ["cell_id", "gene_id"], "full")
    problem = F.when(F.col("times").isNull(), "missing").when(F.col("pos").isNull(), "extra").when(F.col("times") > 1, "repeated").when(F.col("pos") != F.col("got"), "misplaced")
    return met.select("cell_id", "gene_id", problem.alias("problem")).where("problem is not null")


def truncation_report(rows: DataFrame, length: int) -> DataFrame:
    """``(cell_id, positive_genes, tokenized_genes, excluded)`` of ``rows(cell_id, gene_id, pos, count)`` for sentences of ``length`` places.

    A cell's excluded genes are one list in order, bounded by the genes of a cell.
    """
    positive = rows.where("count > 0").groupBy("cell_id", "gene_id").agg(F.min("pos").alias("pos"))
    kept = F.col("pos") <= length
    excluded = F.sort_array(F.collect_list(F.when(~kept, F.col("gene_id"))))
    return positive.groupBy("cell_id").agg(F.count("*").alias("positive_genes"), F.count_if(kept).alias("tokenized_genes"), excluded.alias("excluded"))


def range_correlation(rows: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """``(by..., n, rho, reason)``: rank correlation within each group over the rows where both are finite; fewer than ``least`` have none."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    clean = rows.select(*by, finite(x).alias("__a"), finite(y).alias("__b"))
    used = clean.where("__a is not null and __b is not null").select(*by, average_rank("__a", by).alias("__x"), average_rank("__b", by).alias("__y"))
    found = used.groupBy(*by).agg(F.count("*").alias("n"), pearson("__x", "__y").alias("rho"))
    out = rows.select(*by).distinct().join(found, by, "left").fillna(0, ["n"])
    reason = F.when(F.col("n") < least, "fewer_than_three_finite_genes").when(F.col("rho").isNull(), "constant_score_or_covariate")
    return out.withColumn("reason", reason).withColumn("rho", F.when(F.col("reason").isNull(), F.col("rho")))


def embryo_peers(facts: DataFrame, bins: DataFrame) -> DataFrame:
    """``(focal, peer, embryo_id, m, complete, positive)`` from ``facts(embryo_id, cell_id, gene_id, score)``, each measured once.

    ``m`` is the peer's mean over the focal gene's scored cells of the embryo, measured zeros counted; ``complete`` tells that none
    of these is unavailable, ``positive`` that the peer is scored in one.  Every draw is then a weighted sum.
    """
    cells = facts.select("cell_id", "embryo_id").distinct()
    states = measured_zero(facts, bins).join(cells, "cell_id")
    return states.groupBy("focal", "peer", "embryo_id").agg(
        F.avg(F.coalesce("value", F.lit(0.0))).alias("m"), (F.count_if(F.col("state") == "unavailable") == 0).alias("complete"), F.max(F.col("state") == "scored").alias("positive")
    )


def redrawn_null(facts: DataFrame, bins: DataFrame, weights: DataFrame) -> DataFrame:
    """Each gene's z against its bin's peers for every draw of ``weights(draw, embryo_id, w)``, with the first reason against it.

    ``bins(gene_id, bin)`` covers the genes; a null bin is a band too sparse to compare.  A peer counts where it is complete in every
    embryo that is drawn and has the focal gene.  Peers' standard deviations below 1e-12 are none.
    """
    drawn = weights.where("w > 0")
    own = facts.where("score is not null").groupBy(F.col("gene_id").alias("focal"), "embryo_id").agg(F.avg("score").alias("m"), F.count("*").alias("cells"))
    seen = own.join(drawn, "embryo_id").groupBy("draw", "focal")
    observed = seen.agg(F.sum(F.col("w") * F.col("cells")).alias("scored_cells"), F.sum("w").alias("scored_embryos"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("raw"))
    known = bins.where("bin is not null")
    size = known.groupBy("bin").agg((F.count("*") - 1).alias("candidates"))
    genes = bins.select(F.col("gene_id").alias("focal"), "bin").join(size, "bin", "left").fillna(0, ["candidates"])
    per = embryo_peers(facts, known).join(drawn, "embryo_id").groupBy("draw", "focal", "peer")
    per = per.agg(F.min("complete").alias("complete"), F.max("positive").alias("positive"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("m")).where("complete")
    null = per.groupBy("draw", "focal").agg(F.count("*").alias("matched"), F.count_if("positive").alias("positive"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"))
    # a gene that no drawn embryo has still has a row in every draw
    out = weights.select("draw").distinct().join(F.broadcast(genes) if genes.count() <= 100_000 else genes).join(observed, ["draw", "focal"], "left").join(null, ["draw", "focal"], "left")
    out = out.fillna(0, ["scored_cells", "scored_embryos", "matched", "positive"])
    reason = (
        F.when(F.col("scored_embryos") == 0, "no_focal_scored_cells").when(F.col("bin").isNull(), "unavailable_sparse_dropout_band")
        .when(F.col("matched") < 2, "fewer_than_two_matched_peers").when(F.coalesce("null_sd", F.lit(0.0)) < 1e-12, "zero_or_nonfinite_null_variance")
    )
    out = out.withColumn("reason", reason)
    return out.withColumn("z", F.when(F.col("reason").isNull(), F.try_divide(F.col("raw") - F.col("null_mean"), F.col("null_sd"))))


def occupancy(support: DataFrame, weights: DataFrame) -> DataFrame:
    """``(draw, side, missing, supported)`` from ``support(side, gene_id, embryo_id)`` and ``weights(draw, side, embryo_id, w)``.

    A draw supports a side when each of its genes has an embryo that is drawn.  Genes with the same embryos are one row, so a draw
    meets distinct sets, which embryos bound, and not genes.
    """
    sets = support.groupBy("side", "gene_id").agg(F.sort_array(F.collect_set("embryo_id")).alias("embryos")).groupBy("side", "embryos").agg(F.count("*").alias("genes"))
    drawn = weights.groupBy("draw", "side").agg(F.collect_set(F.when(F.col("w") > 0, F.col("embryo_id"))).alias("drawn"))
    missed = F.sum(F.when(F.arrays_overlap("embryos", "drawn"), 0).otherwise(F.col("genes")))
    out = drawn.join(sets, "side").groupBy("draw", "side").agg(missed.cast("long").alias("missing"))
    return out.withColumn("supported", F.col("missing") == 0)


def feasible(draws: DataFrame) -> DataFrame:
    """One row of ``occupancy``'s draws: how many there are, how many support every side, and whether those are 95 in 100 or more."""
    joint = draws.groupBy("draw").agg(F.min("supported").alias("ok"))
    return joint.agg(F.count("*").alias("draws"), F.count_if("ok").alias("joint")).withColumn("floor_met", 20 * F.col("joint") >= 19 * F.col("draws"))


def potential_support(rows: DataFrame, bins: DataFrame, length: int) -> DataFrame:
    """What a gene could be scored on at most: ``(gene_id, attempts, cells, embryos, peers, failure)`` of ``rows(cell_id, embryo_id, gene_id, pos)``.

    ``pos`` counts from 1; a sentence keeps ``length`` places.  The last gene has no target after it, and in a full sentence the last
    but one has only the end.  A peer is another gene of the bin that has all the gene's cells; two are enough and more are not told.
    """
    kept = rows.where(F.col("pos") <= length)
    ends = kept.groupBy("cell_id").agg(F.count("*").alias("n"))
    last = F.col("n") - F.when(F.col("n") == length, 2).otherwise(1)
    focal = kept.join(ends, "cell_id").where(F.col("pos") <= last).select("gene_id", "cell_id", "embryo_id")
    tried = kept.groupBy("gene_id").agg(F.count("*").alias("attempts"))
    held = focal.groupBy("gene_id").agg(F.count("*").alias("cells"), F.count_distinct("embryo_id").alias("embryos"))
    here = focal.join(bins.where("bin is not null"), "gene_id")
    both = here.select(F.col("gene_id"), "cell_id", "bin").join(here.select(F.col("gene_id").alias("peer"), "cell_id", "bin"), ["cell_id", "bin"]).where("gene_id <> peer")
    shared = both.groupBy("gene_id", "peer").agg(F.count("*").alias("n")).join(held, "gene_id").where("n = cells")
    peers = shared.groupBy("gene_id").agg(F.least(F.lit(2), F.count("*")).alias("peers"))
    out = bins.join(tried, "gene_id", "left").join(held, "gene_id", "left").join(peers, "gene_id", "left").fillna(0, ["attempts", "cells", "embryos", "peers"])
    why = F.when(F.col("cells") == 0, "no_potentially_scorable_cells").when(F.col("bin").isNull(), "unavailable_sparse_dropout_band").when(F.col("peers") < 2, "fewer_than_two_potential_matched_peers")
    return out.select("gene_id", "attempts", "cells", "embryos", "peers", why.alias("failure"))


def unit_weights(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """One row: groups whose weighted mean differs from the plain one by more than 1e-12 of it, and the number of groups."""
    both = rows.groupBy(*by).agg(F.avg(value).alias("plain"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"))
    apart = F.abs(F.col("plain") - F.col("weighted")) > 1e-12 * F.greatest(F.lit(1.0), F.abs("plain"))
    return both.agg(F.count("*").alias("groups"), F.count_if(apart).alias("apart"))
