"""Identifier bridges: which of several possible partners is accepted, and why others are not.

All count partners by aggregation and join the counts back, so an id with very many partners is no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def translate(pairs: DataFrame) -> DataFrame:
    """``(key, target)`` without the targets that more than one key has."""
    clean = pairs.select("key", "target").distinct()
    return clean.groupBy("target").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("key", "target")


def agreed(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(symbol, gene)`` that both sources give, each for that symbol alone."""
    only = lambda t: t.groupBy("symbol").agg(F.count_distinct("gene").alias("n"), F.min("gene").alias("gene")).where("n = 1").select("symbol", "gene")
    return only(first).join(only(second), ["symbol", "gene"])


def cascade(ids: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Each ``id`` with its accession and gene, or the first reason against it: no_old, multiple_old, shared_old, no_new, multiple_new, shared_new.

    ``old(id, accession)`` and ``new(accession, gene)``.
    """
    o, w = old.select("id", "accession").distinct(), new.select("accession", "gene").distinct()
    per_id = o.groupBy("id").agg(F.count("*").alias("n_old"), F.min("accession").alias("accession"))
    per_accession = o.groupBy("accession").agg(F.count("*").alias("n_ids"))
    to_new = w.groupBy("accession").agg(F.count("*").alias("n_new"), F.min("gene").alias("gene"))
    per_gene = w.groupBy("gene").agg(F.count("*").alias("n_accessions"))
    met = ids.select("id").distinct().join(per_id, "id", "left").join(per_accession, "accession", "left").join(to_new, "accession", "left").join(per_gene, "gene", "left")
    why = (
        F.when(F.col("n_old").isNull(), "no_old").when(F.col("n_old") > 1, "multiple_old").when(F.col("n_ids") > 1, "shared_old")
        .when(F.col("n_new").isNull(), "no_new").when(F.col("n_new") > 1, "multiple_new").when(F.col("n_accessions") > 1, "shared_new")
    )
    return met.select("id", F.when(why.isNull(), F.col("gene")).alias("gene"), why.alias("reason"))


def resolve_hits(hits: DataFrame, vocab: DataFrame) -> DataFrame:
    """``hits(query, symbol, gene)`` -> ``(query, gene, status)``: of hits in the vocabulary those whose symbol is the query if there are any; one: mapped, more: ambiguous, none: not_in_vocab."""
    here = hits.join(vocab.select("gene").distinct().withColumn("__here", F.lit(True)), "gene", "left")
    exact = F.collect_set(F.when(F.col("__here") & (F.col("symbol") == F.col("query")), F.col("gene")))
    seen = here.groupBy("query").agg(exact.alias("exact"), F.collect_set(F.when(F.col("__here"), F.col("gene"))).alias("known"))  # a query has a few hits
    seen = seen.withColumn("g", F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("known")))
    status = F.when(F.size("g") == 0, "not_in_vocab").when(F.size("g") == 1, "mapped").otherwise("ambiguous")
    return seen.select("query", F.when(F.size("g") == 1, F.get("g", F.lit(0))).alias("gene"), status.alias("status"))


def audit(published: DataFrame, bridge: DataFrame) -> DataFrame:
    """``(old, new)`` pairs that are unique on both sides, against the gene an existing bridge has for ``old``: agrees, conflicts, additional."""
    clean = published.select("old", "new").distinct()
    one_old = clean.groupBy("old").agg(F.count("*").alias("n"), F.min("new").alias("new")).where("n = 1").select("old", "new")
    one_new = clean.groupBy("new").agg(F.count("*").alias("n")).where("n = 1").select("new")
    met = one_old.join(one_new, "new", "left_semi").join(bridge.select("old", F.col("new").alias("had")), "old", "left")
    return met.select("old", "new", F.when(F.col("had").isNull(), "additional").when(F.col("had") == F.col("new"), "agrees").otherwise("conflicts").alias("status"))


def prefix_match(names: DataFrame, species: DataFrame) -> DataFrame:
    """``names(name)`` to ``species(species)`` whose ``species_`` a name begins with: an equi-join on every prefix that ends before an underscore, so no nested loop."""
    cut = F.expr("transform(filter(sequence(1, length(name)), i -> substring(name, i, 1) = '_'), i -> substring(name, 1, i - 1))")
    return names.select("name", F.explode(cut).alias("species")).join(species, "species").select("name", "species")
