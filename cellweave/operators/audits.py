"""Gates, status checks, reconciliations and reports over relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds each target: ``"=text"`` is a constant, else a source column.  A target that is there stays; a missing source raises."""
    for target, source in fields.items():
        if target in rows.columns:
            continue
        if not source.startswith("=") and source not in rows.columns:
            raise ValueError(f"no column {source} for {target}")
        rows = rows.withColumn(target, F.lit(source[1:]) if source.startswith("=") else F.col(source))
    return rows


def strict_map(label: Column, mapping: dict[str, str]) -> Column:
    """The mapped label; a missing or unknown one fails the query."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.raise_error(F.concat(F.lit("no stage for "), F.coalesce(label, F.lit("<null>")))).cast("string"))


def donor_version(donor: Column, border: int = 16) -> Column:
    """``v1`` below and ``v2`` above the border of the number a donor's name ends with; null at it or without one."""
    n = F.regexp_extract(donor, r"(\d+)$", 1)
    n = F.when(n != "", n).cast("int")
    return F.when(n < border, "v1").when(n > border, "v2")


def genes_with_total(expr: DataFrame, least: float) -> DataFrame:
    return expr.groupBy("gene_id").agg(F.sum("count").alias("total")).where(F.col("total") >= least).select("gene_id")


def one_organism(primary: Column, organisms: Column, wanted: list[str]) -> Column:
    """Primary data of exactly one organism, one of those wanted whatever its case."""
    return F.coalesce(F.get(primary, F.lit(0)) & (F.size(organisms) == 1) & F.lower(F.get(organisms, F.lit(0))).isin([w.lower() for w in wanted]), F.lit(False))


def row_status(status: Column, n: Column, value: Column) -> Column:
    """Null for a consistent row, else what is wrong: scored rows have targets and a finite value, others neither."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when((status == "scored") & ~((n > 0) & finite), "scored_without_value").when((status != "scored") & ~((n == 0) & value.isNull()), "value_without_score")


def holdout_status(passed: Column, name: Column) -> Column:
    """The first of: QC failure, a mixed label, pending."""
    return F.when(~passed, "ineligible_source_rna_qc_fail").when(F.contains(F.lower(name), F.lit("embryomixed")), "ineligible_mixed_embryo_label").otherwise("pending")


def positional_mismatches(rows: DataFrame, sidecar: DataFrame, at: str, same: list[str]) -> DataFrame:
    """Rows of two tables that stand at the same place but disagree, or stand in one only: ``(at, problem)``."""
    right = sidecar.select(F.col(at).alias("__at"), *[F.col(c).alias(f"__{c}") for c in same])
    met = rows.join(right, F.col(at) == F.col("__at"), "full")
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    problem = F.when(F.col("__at").isNull(), "missing_in_sidecar").when(F.col(at).isNull(), "not_in_rows").when(differs, "differs")
    return met.select(F.coalesce(at, "__at").alias(at), problem.alias("problem")).where("problem is not null")


def reconcile(counters: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Counters ``(key..., n)`` side by side, 0 where a key has none: one aggregation over their union, not a chain of outer joins."""
    tagged = reduce(DataFrame.union, [c.select(*key, F.lit(name).alias("__c"), F.col("n").cast("long").alias("n")) for name, c in counters.items()])
    return tagged.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("__c") == name, F.col("n"))), F.lit(0)).alias(name) for name in counters])


def set_digest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """``(by..., n, digest)``: the SHA-256 of each group's distinct keys in order as a compact JSON array.  A group's keys are one array: for sets of a bounded size."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(F.col(key).cast("string"))).alias("k")).select(*by, F.size("k").cast("long").alias("n"), F.sha2(F.to_json("k"), 256).alias("digest"))


def relative_improvement(losses: DataFrame, by: str, base: str, candidate: str, weight: str, veto: str = "-0.02") -> DataFrame:
    """Each group's ``(base - candidate) / |base|`` of weighted sums in decimals, and whether it is below the veto; a zero base is null."""
    exact = "decimal(20,6)"
    sums = losses.groupBy(by).agg(*[F.sum((F.col(c).cast(exact) * F.col(weight).cast("decimal(10,0)")).cast(exact)).cast(exact).alias(c) for c in (base, candidate)])
    gain = F.try_divide(F.col(base) - F.col(candidate), F.abs(base))
    return sums.select(by, gain.cast("decimal(20,6)").alias("gain")).withColumn("vetoed", F.col("gain") < F.lit(veto).cast("decimal(20,6)"))


def evaluable_mean(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Unweighted mean over the groups that have a value, the number of these and of the others."""
    per = rows.groupBy(*by, group).agg(F.avg(value).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.count("m").alias("evaluable"), F.count_if(F.col("m").isNull()).alias("not_evaluable"))


def floors(n: Column, paired: Column, joined: Column, least: int = 500) -> Column:
    """Whether a report may be made: enough pairs, and four in five of the joined ones, in whole numbers."""
    return (n >= least) & (5 * paired >= 4 * joined)


def eligibility(mapped_a: Column, all_a: Column, mapped_b: Column, all_b: Column, pairs: Column, share: float = 0.6, least: int = 5000) -> Column:
    """``eligible``, ``below_floor``, or ``unevaluable`` where an input is missing or empty."""
    known = F.coalesce(all_a, F.lit(0)) * F.coalesce(all_b, F.lit(0)) > 0
    ok = (F.try_divide(mapped_a, all_a) >= share) & (F.try_divide(mapped_b, all_b) >= share) & (pairs >= least)
    return F.when(~known | mapped_a.isNull() | mapped_b.isNull() | pairs.isNull(), "unevaluable").when(ok, "eligible").otherwise("below_floor")


def pair_status(a: Column, b: Column, state_a: Column, state_b: Column) -> Column:
    """Why a pair of scores cannot be used, the first of: missing, unavailable, not finite; null for a usable one."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(state_a.isNull() | state_b.isNull(), "missing").when((state_a != "scored") | (state_b != "scored"), "unavailable").when(bad(a) | bad(b), "nonfinite")


def coverage_gap(required: DataFrame, covered: DataFrame, by: str, key: str, show: int = 50) -> DataFrame:
    """``(by, required, covered, missing)``: of the keys each group requires, how many are covered, and the first that are not."""
    have = covered.select(by, key).distinct().withColumn("__have", F.lit(True))
    met = required.select(by, key).distinct().join(have, [by, key], "left")
    place = F.row_number().over(Window.partitionBy(by, F.col("__have").isNull()).orderBy(key))
    met = met.withColumn("__place", place)
    shown = F.array_join(F.sort_array(F.collect_list(F.when(F.col("__have").isNull() & (F.col("__place") <= show), F.col(key)))), ",")
    return met.groupBy(by).agg(F.count("*").alias("required"), F.count("__have").alias("covered"), shown.alias("missing"))


def modality_mix(lengths: dict[str, int], shares: dict[str, float], seed: int, spark) -> DataFrame:
    """``(index, modality, row)``: twice the longest modality's length of draws with replacement, each by a seeded hash of its index."""
    n = 2 * max(lengths.values())
    unit = lambda salt: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), "index"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = spark.range(n).select(F.col("id").alias("index")).withColumns({"u": unit("modality"), "v": unit("row")})
    modality, size, up = None, None, 0.0
    for name in list(lengths)[:-1]:
        up += shares[name]
        modality = F.when(F.col("u") < up, name) if modality is None else modality.when(F.col("u") < up, name)
        size = F.when(F.col("u") < up, lengths[name]) if size is None else size.when(F.col("u") < up, lengths[name])
    last = list(lengths)[-1]
    modality, size = (F.lit(last), F.lit(lengths[last])) if modality is None else (modality.otherwise(last), size.otherwise(lengths[last]))
    return drawn.select("index", modality.alias("modality"), F.floor(F.col("v") * size).cast("long").alias("row"))


def stratified_test(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """Adds ``test``: that share of each class by hash order, at least one row on either side of a class of two or more."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key)
    ranked = rows.withColumns({"__r": F.row_number().over(order), "__n": F.count("*").over(Window.partitionBy(label))})
    wanted = F.when(F.col("__n") < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.col("__n") * share + 0.5))))
    return ranked.withColumn("test", F.col("__r") <= wanted).drop("__r", "__n")
