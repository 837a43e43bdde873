"""Evidence and report operators on small tables, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from cellweave.operators import evidence, reports


def test_log_gamma_is_that_of_the_standard_library(spark):
    xs = [1e-5, 0.5, 1.0, 1.5, 2.0, 7.25, 51.0, 1e4, 1e10]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", evidence.log_gamma(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)


def test_cell_loss_leaves_masked_genes_out_and_is_null_without_others(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, False), (1, 9.0, 1.0, True), (2, 1.0, 1.0, True), (3, 1e-9, 1.0, False)], "cell long, mu double, c double, m boolean")
    got = {r.cell: r for r in evidence.cell_loss(rows, "cell", "mu", "c", "m").collect()}
    rate = 2.0 + 1e-5
    assert got[1].n == 1 and got[1].loss == pytest.approx(rate - math.log1p(math.exp(-rate)) - 3 * math.log(rate) + math.lgamma(4))
    assert got[2].n == 0 and got[2].loss is None
    assert got[3].loss == pytest.approx(-math.log(1e-9 + 1e-5))  # the normaliser is held at 0


def test_deletion_impact_counts_only_genes_after_the_deleted_one(spark):
    whole = spark.createDataFrame([(1, 0, "a", -1.0), (1, 1, "b", -2.0), (1, 2, "c", -3.0)], "cell_id long, pos int, gene_id string, logp double")
    gone = spark.createDataFrame([(1, 1, "a", -9.0), (1, 1, "c", -3.5), (1, 2, "a", -4.0), (1, 1, "new", -1.0)], "cell_id long, at int, gene_id string, logp double")
    got = {r.at: r for r in evidence.deletion_impact(whole, gone).collect()}
    assert got[1].n == 1 and got[1].bits == pytest.approx(0.5 / math.log(2)) and got[1].reason is None
    assert got[2].n == 0 and got[2].bits is None and got[2].reason == "no_matched_targets"


def test_token_problems_of_each_kind(spark):
    t = "cell_id long, gene_id string, pos int"
    expected = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3)], t)
    actual = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "d", 3), (1, "d", 3), (2, "a", 0)], t)
    got = {(r.cell_id, r.gene_id): r.problem for r in evidence.token_problems(expected, actual).collect()}
    assert got == {(1, "b"): "misplaced", (1, "c"): "missing", (1, "d"): "repeated", (2, "a"): "extra"}
    assert evidence.token_problems(expected, expected).isEmpty()


def test_range_correlation_needs_three_finite_pairs(spark):
    nan = float("nan")
    rows = [("few", 1.0, 1.0), ("few", nan, 2.0), ("few", 3.0, None), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 3.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", 9.0, 5.0), ("none", nan, 1.0)]
    got = {r.g: r for r in evidence.range_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert (got["few"].n, got["few"].reason) == (1, "fewer_than_three_finite_genes")
    assert (got["none"].n, got["none"].reason) == (0, "fewer_than_three_finite_genes")
    assert got["flat"].rho is None and got["flat"].reason == "constant_score_or_covariate"
    assert got["up"].rho == pytest.approx(1.0) and got["up"].reason is None


def test_redrawn_null_equals_brute_force(spark):
    facts = [(c % 3, c, g, None if (c + i) % 5 == 0 else float((c * 7 + i * i) % 11)) for c in range(9) for i, g in enumerate("abcdef") if (c * i) % 4 != 3]
    bins = {g: None if g == "f" else "x" for g in "abcdef"}
    weights = [(d, e, (e * (d + 1) + d) % 3) for d in range(3) for e in range(3)]
    out = evidence.redrawn_null(
        spark.createDataFrame(facts, "embryo_id int, cell_id int, gene_id string, score double"),
        spark.createDataFrame(list(bins.items()), "gene_id string, bin string"),
        spark.createDataFrame(weights, "draw int, embryo_id int, w int"),
    )
    got = {(r.draw, r.focal): r for r in out.collect()}
    score = {(c, g): s for _, c, g, s in facts}
    assert len(got) == 18
    for (d, g), r in got.items():
        w = {e: x for dd, e, x in weights if dd == d and x > 0}
        cells = {e: [c for ee, c, gg, s in facts if ee == e and gg == g and s is not None] for e in w}
        cells = {e: c for e, c in cells.items() if c}
        total = sum(w[e] for e in cells)
        mean = lambda p: sum(w[e] * sum(score.get((c, p)) or 0.0 for c in cells[e]) / len(cells[e]) for e in cells) / total  # noqa: B023, E731
        whole = [p for p in "abcdef" if p != g and bins[p] and bins[g] and all((c, p) not in score or score[c, p] is not None for e in cells for c in cells[e])] if total else []
        assert (r.scored_embryos, r.matched) == (total, len(whole))
        if total:
            assert r.raw == pytest.approx(mean(g))
        if r.reason is None:
            values = [mean(p) for p in whole]
            m = sum(values) / len(values)
            assert r.z == pytest.approx((r.raw - m) / math.sqrt(sum((v - m) ** 2 for v in values) / (len(values) - 1)))
    assert got[1, "f"].reason == "unavailable_sparse_dropout_band"


def test_overlaps_by_name_and_after_normalising(spark):
    rows = [("s", "p", "A-1"), ("s", "q", "A-2"), ("s", "p", "B"), ("s", "q", "B"), ("s", "r", "C"), ("s", "r", None), ("t", "u", "B")]
    got = {(r.a, r.b): (r.raw, r.normal, r.level) for r in reports.overlaps(spark.createDataFrame(rows, "species string, file string, name string"), F.regexp_replace("name", r"-\d+$", ""), 1).collect()}
    assert got == {("p", "q"): (1, 2, "FAIL"), ("p", "r"): (0, 0, "PASS"), ("q", "r"): (0, 0, "PASS")}


def test_blocks_without_a_gene_keep_their_products(spark):
    b = spark.createDataFrame([("transcript_id=t1.2 protein_id=p1 protein_id=p2",), ("gene_id=g",), (None,), ("gene_id=g transcript_id=t protein_id=p gene_id=h",)], "block string")
    got = {tuple(r) for r in reports.block_products(b).collect()}
    assert got == {(None, "t1.2", "p1"), (None, "t1.2", "p2"), ("g", "t", "p")}


def test_recorded_plan_findings(spark):
    plan = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 1, "b"), ("f", 7, "a")], "file string, row int, split string")
    told = spark.createDataFrame([("f", "a", 2), ("f", "b", 1), ("f", "c", 4)], "file string, split string, n int")
    got = {(r.split, r.problem, r.n) for r in reports.plan_problems(plan, told, spark.createDataFrame([("f", 4)], "file string, rows int")).collect()}
    assert got == {(None, "outside", 1), (None, "repeated", 1), (None, "not_planned", 2), ("b", "count_differs", 1), ("c", "count_differs", -4)}


def test_worst_level_and_blockers(spark):
    rows = spark.createDataFrame([("a", "PASS"), ("a", "WARN"), ("b", "PASS"), ("c", "FAIL"), ("c", "PASS")], "d string, level string")
    assert {r.d: (r.findings, r.level) for r in reports.worst(rows, ["d"], "level").collect()} == {"a": (2, "WARN"), "b": (1, "PASS"), "c": (2, "FAIL")}
    one = spark.range(1).select(reports.blockers({"x": F.lit(True), "y": F.lit(None).cast("boolean"), "z": F.lit(True)}).alias("m"))
    assert one.first().m == "x; z"
