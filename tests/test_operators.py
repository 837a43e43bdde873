"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from cellweave.functions import identifiers
from cellweave.operators import aggregates, bins, bootstrap, joins, nulls, quality_control, ranking, sampling, vectors
from cellweave.sources import sinks, text_formats
from cellweave.streaming import folds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bins_merge_as_a_plain_loop_does(spark):
    """Random bands: every bin is large enough, or the band has none; joined as by a loop over a text of members, one letter a bin."""
    import random
    import re

    r = random.Random(31)
    bands = [[r.choice([0, 3, 17, 49, 50, 51, 80]) + r.randint(0, 4) for _ in range(r.randint(1, 10))] for _ in range(300)]

    def by_text(counts):
        text = "|".join("x" * n + f"<{i}>" for i, n in enumerate(counts))
        while True:
            parts = text.split("|")
            n = [p.count("x") for p in parts]
            low = [i for i in range(len(parts)) if n[i] < 50]
            if not low or len(parts) == 1:
                return None if low else [[int(d) for d in re.findall(r"<(\d+)>", p)] for p in parts]
            i = low[0]
            to_left = i == len(parts) - 1 or (i > 0 and n[i - 1] <= n[i + 1])
            cut = i - 1 if to_left else i
            text = "|".join(parts[:cut] + [parts[cut] + parts[cut + 1]] + parts[cut + 2 :])

    df = spark.createDataFrame([(k, [(i, i, n) for i, n in enumerate(b)]) for k, b in enumerate(bands)], "k int, b array<struct<lo:int,hi:int,n:bigint>>")
    got = {x.k: x.m and [list(range(b.lo, b.hi + 1)) for b in x.m] for x in df.select("k", bins.merge("b", 50).alias("m")).collect()}
    assert [got[k] for k in range(300)] == [by_text(b) for b in bands]


def test_midrank_deciles_against_counting(spark):
    import random

    r = random.Random(2)
    values = [float(r.randint(0, 6)) for _ in range(157)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "i int, v double, g int")
    got = {x.i: x.d for x in df.select("i", ranking.midrank_decile("v", ["g"]).alias("d")).collect()}
    for i, v in enumerate(values):
        below, same = sum(x < v for x in values), values.count(v)
        assert got[i] == min(9, int(10 * (below + same / 2) // len(values)))


def test_matched_peers_against_loops(spark):
    import random
    import statistics

    r = random.Random(17)
    cells = {f"cell{i}": f"emb{i % 3}" for i in range(9)}
    score = {(c, g): r.random() for c in cells for g in ("g0", "g1", "g2", "g3", "g4") if r.random() < (0.45 if g == "g0" else 0.85)}
    df = spark.createDataFrame([(cells[c], c, g, v) for (c, g), v in score.items()], "embryo_id string, cell_id string, gene_id string, score double")
    b = spark.createDataFrame([(f"g{i}", int(i == 4)) for i in range(5)], "gene_id string, bin int")

    def balanced(gene, where):
        per = [[score[c, gene] for c in where if cells[c] == e] for e in sorted(set(cells.values()))]
        return statistics.mean(statistics.mean(v) for v in per if v)

    for x in nulls.matched_peer_z(df, b).collect():
        mine = [c for c in cells if (c, x.focal) in score]
        peers = [g for g in ("g0", "g1", "g2", "g3") if g != x.focal and x.focal != "g4" and any((c, g) in score for c in mine)]
        whole = [balanced(g, mine) for g in peers if all((c, g) in score for c in mine)]
        assert (x.candidates, x.matched, x.n_cells) == (len(peers), len(whole), len(mine))
        assert x.observed == pytest.approx(balanced(x.focal, mine))
        assert x.z == (pytest.approx((balanced(x.focal, mine) - statistics.mean(whole)) / statistics.stdev(whole)) if len(whole) >= 2 else None)


def test_bijection_and_bridge_against_loops(spark):
    import collections
    import random

    r = random.Random(3)
    pairs = {(r.randint(0, 60), r.randint(100, 160)) for _ in range(70)}
    na, nb = collections.Counter(a for a, _ in pairs), collections.Counter(b for _, b in pairs)
    df = spark.createDataFrame([*pairs, *list(pairs)[:9]], "a long, b long")
    assert rows(joins.strict_bijection(df, "a", "b")) == sorted(((a, b) for a, b in pairs if na[a] == nb[b] == 1), key=repr)
    left, right = [(i, r.randint(0, 40)) for i in range(40)], [(r.randint(0, 40), 500 + i) for i in range(40)]
    got = rows(joins.compose_bridge(spark.createDataFrame(left, "a long, via long"), spark.createDataFrame(right, "via long, b long")))
    once = lambda v, of: sum(x == v for x in of) == 1
    assert got == sorted(((a, b) for a, v in left for w, b in right if v == w and once(v, [x for _, x in left]) and once(v, [x for x, _ in right])), key=repr)


def test_interval_overlap_sees_long_early_intervals(spark):
    left = spark.createDataFrame([(1, "s", 100, 110), (2, "s", 500, 501)], "id long, seq string, start long, end long")
    right = spark.createDataFrame([(10, "s", 1, 400), (11, "s", 90, 95), (12, "s", 500, 500), (13, "s", 501, 501)], "id long, seq string, start long, end long")
    got = {r.id: r for r in joins.interval_overlap(left, right, 32).collect()}
    assert (got[1].hit, got[1].overlap, got[1].ambiguous) == (10, 11, False)
    assert (got[2].hit, got[2].overlap, got[2].ambiguous) == (None, 1, True)


def test_interval_overlap_against_all_pairs(spark):
    """Random intervals in several buckets, with ties, copies, nulls and ids as text: as by comparing all pairs; no pair is a row of the plan."""
    import random

    r = random.Random(8)

    def some(n, most):
        out = [(f"{i:03d}" if r.random() > 0.03 else None, r.choice(["p", "q", None]) if r.random() < 0.3 else "p", s := r.randint(-60, 120), s + r.randint(-1, most)) for i in range(n)]
        return [*out, *out[:5], ("900", "p", None, 4), ("901", "p", 9, None)]

    left, right = some(250, 30), some(160, 70)
    want = {}
    for i in {x[0] for x in left} - {None}:
        met = [(min(e, e2) - max(s, s2) + 1, hit, e - s + 1, e2 - s2 + 1) for j, q, s, e in left if i == j and q and s is not None and e is not None and s <= e for hit, q2, s2, e2 in right if q == q2 and s2 is not None and e2 is not None and s2 <= e2 and s <= e2 and s2 <= e]
        if met:
            best = [x for x in met if x[0] == max(y[0] for y in met)]
            hit = min((x[1] for x in best if x[1]), default=None)
            sizes = {x[3] for x in best if x[1] == hit} if hit else {None}
            want[i] = (hit if len(best) == 1 else None, best[0][0], len(best) > 1, {None if z is None else min(best[0][0] / best[0][2], best[0][0] / z) for z in sizes})
    kind = "id string, seq string, start long, end long"
    for width in (7, 64, 1000):
        got = joins.interval_overlap(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), width)
        told = {x.id: x for x in got.collect()}
        assert {k: (x.hit, x.overlap, x.ambiguous) for k, x in told.items()} == {k: v[:3] for k, v in want.items()}
        assert all(told[k].reciprocal in v[3] or None in v[3] for k, v in want.items())
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_mean_pool_shuffles_no_vectors(spark, monkeypatch):
    """Means by matrix and by join equal the hand-made ones: unknown tokens left out, repeated ids, null and ragged vectors; the first shuffles no vector."""
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (2, [5.0, 7.0]), (3, None), (4, [9.0]), (5, [None, 1.0]), (None, [8.0, 8.0])], "id long, v array<double>")
    t = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 9), ("d", 4), ("d", 1), ("e", 5), ("e", 2), (None, 1), ("f", None)], "cell string, token long")
    want = {"a": [2.5, 17 / 4], "d": [5.0, 2.0], "e": [4.0, 14 / 3], None: [1.0, 2.0]}
    for most in (vectors.MATRIX, 0):
        monkeypatch.setattr(vectors, "MATRIX", most)
        got = vectors.mean_pool(t, e, "cell", "token")
        assert {x.cell: x.v for x in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
        if most:
            assert "dim" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_identifiers(spark):
    df = spark.createDataFrame([("ENSG77.12",), ("9Q8.3",), ("FBgn5.1",)], "g string")
    assert rows(df.select(identifiers.strip_version(F.col("g")))) == [("9Q8.3",), ("ENSG77",), ("FBgn5",)]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0)], "g int, x double, y double")
    assert {r.g: (r.rho, r.reason) for r in ranking.spearman(df, ["g"], "x", "y").collect()} == {1: (None, "constant_input"), 2: (None, "fewer_than_two_pairs")}


def test_splits_cover_and_are_disjoint(spark):
    units = spark.createDataFrame([("s", i, i == 0) for i in range(11)] + [("t", i, False) for i in range(2)], "species string, embryo_id int, train_only boolean")
    got = sampling.assign_splits(units)
    assert got.count() == 13
    assert {r.split: r["count"] for r in got.where("species = 's'").groupBy("split").count().collect()} == {"train": 8, "validation": 2, "holdout": 1}
    assert got.where("species = 't'").select("split", "reason").distinct().collect() == [("train", "insufficient_embryos")]


def test_cka_is_one_for_itself_rotated(spark):
    import random

    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(30)], "id long, v array<double>")
    turned = v.select("id", F.array(F.col("v")[1], -F.col("v")[0]).alias("v"))
    assert vectors.linear_cka(v, turned).first().cka == pytest.approx(1.0)


def test_qc_reasons_overlap(spark):
    m = spark.createDataFrame([(1, 1, 5.0), (2, 5, 100.0)], "cell_id int, n_genes long, total_counts double")
    r = quality_control.removal_counts(quality_control.qc_reasons(m, 2, 10, 0, 0)).first()
    assert (r.below_min_genes, r.below_min_counts, r.kept, r.total) == (1, 1, 1, 2)


def test_early_stopping(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 2, 2, 2, 1])] + [(2, 0, 1.0)], "run long, step long, loss double")
    assert rows(folds.early_stops(df, 2)) == rows(folds.early_stops(df, 2, 1e-9)) == [(1, 3), (2, None)]
    assert rows(folds.early_stops(df, 2, 5.0)) == [(1, 2), (2, None)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\nchr1\tx\tgene\t5\t9\t.\t+\t.\tID=g1;Name=N\n")
    r = text_formats.gff(spark, str(tmp_path / "a.gff")).first()
    assert (r.seqid, r.start, r.end, r.attributes["Name"]) == ("chr1", 5, 9, "N")
    (tmp_path / "a.fa").write_text(">P1 gene=G1 some text\nMKV\n")
    assert tuple(text_formats.fasta_headers(spark, str(tmp_path / "a.fa")).first()) == ("P1", "G1", "gene=G1 some text")
    (tmp_path / "s.jsonl").write_text('{"kind":"header"}\n{"kind":"row","x":1}\n{"kind":"footer","count":2}\n')
    assert text_formats.shards(spark, str(tmp_path / "s.jsonl"), "x long").count() == 1
    assert text_formats.shard_mismatches(spark, str(tmp_path / "s.jsonl")).count() == 1


def test_publish_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    sinks.publish(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.publish(df, str(tmp_path / "t"))


def test_bootstrap_draws_real_embryos(spark):
    """Every draw takes as many embryos of a species as it has, all embryos are drawn, and the draws differ."""
    s = spark.createDataFrame([(g, i + 100 * (g == "b"), float(i)) for g, n in (("a", 40), ("b", 7)) for i in range(n)], "species string, embryo_id long, m double")
    w = bootstrap.draw_weights(s, ["species"]).cache()
    assert rows(w.groupBy("draw", "species").agg(F.sum("w").alias("n")).groupBy("species", "n").count()) == [("a", 40, 2000), ("b", 7, 2000)]
    assert w.select("embryo_id").distinct().count() == 47
    assert all(1900 < x.n < 2100 for x in w.where("species = 'a'").groupBy("embryo_id").agg(F.sum("w").alias("n")).collect())
    got = {x.species: x for x in bootstrap.interval(s, w, ["species"]).collect()}
    assert got["a"].n_draws == got["b"].n_draws == 2000
    # 1.96 standard errors of the mean of 0..39, by the normal approximation
    assert got["a"].mean == 19.5 and abs(got["a"].half_width - 1.96 * (1599 / 12 / 40) ** 0.5) < 0.3


def test_bootstrap_draws_without_shuffled_slots(spark, monkeypatch):
    """The means of all draws equal those by weights, by broadcast and dealt out, and no plan shuffles a slot."""
    s = spark.createDataFrame([(g, i * 3 % 41 + 100 * "abc".index(g), None if i == 5 else float(i) ** 1.5) for g, n in (("a", 41), ("b", 7), ("c", 1)) for i in range(n)], "species string, embryo_id long, m double")
    w = aggregates.weighted_mean(s, bootstrap.draw_weights(s, ["species"], 50).drop("species"), ["draw", "species"])
    want = {(x.draw, x.species): x.mean for x in w.collect()}
    for most in (bootstrap.ARRAYS, 0):
        monkeypatch.setattr(bootstrap, "ARRAYS", most)
        got = bootstrap.drawn_means(s, ["species"], 50)
        assert {(x.draw, x.species): pytest.approx(x.drawn) for x in got.collect()} == want and len(want) == 150
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "slot" not in plan


def test_bootstrap_query_has_all_draws(spark):
    from cellweave.plans import registry

    got = registry.QUERIES["bootstrap_interval"](spark, "/root/testdata/sf0.001").collect()
    assert got and {x.n_draws for x in got} == {2000}


def test_whole_queries_read_every_row(spark):
    """Their results cover all cells, pairs and orders of the tables."""
    from cellweave.plans import registry

    d = "/root/testdata/sf0.001"
    l, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    run = lambda name: registry.QUERIES[name](spark, d)
    assert run("pooled_gene_embeddings_whole").count() == l.select("l_orderkey").distinct().count()
    pairs = l.selectExpr("l_partkey * 100 + l_orderkey % 100 as a", "l_suppkey * 1000 + l_orderkey % 1000 as b").distinct().count()
    told = {x.reason: x.n for x in run("conversion_ambiguity_whole").collect()}
    assert sum(told.values()) == pairs and len(told) == 3
    assert 0 < run("strict_bijection_whole").count() <= told["one_to_one"]
    assert run("bridge_composition_whole").count() > o.where("o_orderkey % 13 = 0").count()
    assert run("interval_overlap_whole").where("hit % 3 = 2").count() > 0
