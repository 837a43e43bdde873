"""Registered queries over likelihoods, support, redrawn nulls and dataset reports, each over whole tables with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import identifiers
from cellweave.operators import evidence, reports, vectors
from cellweave.plans.registry import query
from cellweave.sources.tables import OBS_SQL, obs, read


@query("""with r as (select l_orderkey as cell_id, l_extendedprice / 1000 + 1e-5 as mu, l_quantity as c, l_linenumber = 1 as masked from lineitem)
select cell_id, count(*) filter (not masked) as n, round(avg(greatest(0, mu - ln(1 + exp(-mu))) - c * ln(mu) + lgamma(c + 1)) filter (not masked), 6) as loss from r group by 1""")
def count_likelihood(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_extendedprice") / 1000).alias("mu"), F.col("l_quantity").alias("c"), (F.col("l_linenumber") == 1).alias("masked"))
    return evidence.cell_loss(l, "cell_id", "mu", "c", "masked").withColumn("loss", F.round("loss", 6))


@query("""with w as (select l_orderkey as cell_id, l_linenumber as pos, l_partkey as gene_id, -l_tax - 0.01 as logp from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) = 1),
x as (select cell_id, p.l_linenumber as "at", gene_id, pos, logp, logp - p.l_discount as less from w join lineitem p on p.l_orderkey = cell_id)
select cell_id, "at", count(*) filter (pos > "at") as n, round(avg((logp - less) / ln(2)) filter (pos > "at"), 6) as bits, case when count(*) filter (pos > "at") = 0 then 'no_matched_targets' end as reason from x group by 1, 2""")
def deletion_impacts(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("gene_id"), (-F.col("l_tax") - 0.01).alias("logp"), "l_discount")
    whole = l.groupBy("cell_id", "gene_id").agg(F.min(F.struct("pos", "logp")).alias("f")).select("cell_id", "f.pos", "gene_id", "f.logp")
    gone = l.select("cell_id", F.col("pos").alias("at"), "l_discount")
    deleted = whole.join(gone, "cell_id").select("cell_id", "at", "gene_id", (F.col("logp") - F.col("l_discount")).alias("logp"))
    return evidence.deletion_impact(whole, deleted).withColumn("bits", F.round("bits", 6))


@query("""with e as (select l_orderkey as cell_id, l_partkey as gene_id, min(l_linenumber) as pos from lineitem where l_quantity > 4 group by 1, 2),
a as (select l_orderkey as cell_id, l_partkey as gene_id, l_linenumber + case when l_tax > 0.07 then 1 else 0 end as pos from lineitem where l_discount < 0.1),
g as (select cell_id, gene_id, count(*) as times, min(pos) as got from a group by 1, 2)
select * from (select coalesce(e.cell_id, g.cell_id) as cell_id, coalesce(e.gene_id, g.gene_id) as gene_id, case when times is null then 'missing' when e.pos is null then 'extra' when times > 1 then 'repeated' when e.pos <> got then 'misplaced' end as problem
from e full join g on e.cell_id = g.cell_id and e.gene_id = g.gene_id) where problem is not null""")
def token_reconciliation(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), "l_linenumber", "l_quantity", "l_discount", "l_tax")
    expected = l.where("l_quantity > 4").groupBy("cell_id", "gene_id").agg(F.min("l_linenumber").alias("pos"))
    actual = l.where("l_discount < 0.1").select("cell_id", "gene_id", F.expr("l_linenumber + if(l_tax > 0.07, 1, 0)").alias("pos"))
    return evidence.token_problems(expected, actual)


@query("""with p as (select l_orderkey as cell_id, l_partkey as gene_id, min(l_linenumber) as pos from lineitem where l_quantity > 4 group by 1, 2)
select cell_id, count(*) as positive_genes, count(*) filter (pos <= 3) as tokenized_genes, coalesce(string_agg(cast(gene_id as varchar), ',' order by gene_id) filter (pos > 3), '') as excluded from p group by 1""")
def truncation_exclusions(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") - 4).alias("count"))
    return evidence.truncation_report(l, 3).withColumn("excluded", F.array_join(F.col("excluded").cast("array<string>"), ","))


@query("""with u as (select l_orderkey as g, l_quantity as a, l_discount as b from lineitem where l_tax < 0.07),
r as (select g, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0 as x, rank() over (partition by g order by b) + (count(*) over (partition by g, b) - 1) / 2.0 as y from u),
s as (select g, count(*) as n, stddev_pop(x) * stddev_pop(y) as sd, covar_pop(x, y) as c from r group by 1)
select o.g as gene_range, coalesce(n, 0) as n, case when n >= 3 and sd > 0 then round(c / sd, 6) end as rho, case when coalesce(n, 0) < 3 then 'fewer_than_three_finite_genes' when sd = 0 then 'constant_score_or_covariate' end as reason
from (select distinct l_orderkey as g from lineitem) o left join s on s.g = o.g""")
def range_diagnostics(spark, d):
    score = F.when(F.col("l_tax") < 0.07, F.col("l_quantity"))
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene_range"), score.alias("score"), F.col("l_discount").alias("covariate"))
    return evidence.range_correlation(l, ["gene_range"], "score", "covariate").withColumn("rho", F.round("rho", 6))


_FACTS = """f as (select l_suppkey as cell_id, s_nationkey as embryo_id, p_brand || split_part(p_type, ' ', 1) as gene_id, avg(case when l_discount > 0.01 then l_quantity end) as score from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
b as (select distinct gene_id, case when gene_id not like 'Brand#5%' then substr(gene_id, 1, 8) end as bin from f), w as (select d as draw, n_nationkey as embryo_id, (n_nationkey * (d + 3) + d) % 3 as w from nation, (select unnest(range(0, 4)) as d))"""


def _facts(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("score"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1))).alias("gene_id"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("embryo_id"))
    return l.join(p, "l_partkey").join(s, "l_suppkey").groupBy(F.col("l_suppkey").alias("cell_id"), "embryo_id", "gene_id").agg(F.avg("score").alias("score"))


def _bins(facts):
    return facts.select("gene_id").distinct().withColumn("bin", F.when(~F.startswith("gene_id", F.lit("Brand#5")), F.substring("gene_id", 1, 8)))


@query(f"""with {_FACTS}, q as (select f.*, bin from f join b using (gene_id)), k as (select gene_id as focal, cell_id, embryo_id, bin from q where score is not null and bin is not null),
x as (select k.focal, b.gene_id as peer, k.cell_id, k.embryo_id from k join b on b.bin = k.bin and b.gene_id <> k.focal),
y as (select x.*, f.score, f.gene_id is not null as expressed from x left join f on f.gene_id = x.peer and f.cell_id = x.cell_id),
e as (select focal, peer, embryo_id, avg(coalesce(score, 0)) as m, count(*) filter (expressed and score is null) = 0 as complete, bool_or(score is not null) as positive from y group by 1, 2, 3),
o as (select draw, focal, sum(w * cells)::bigint as scored_cells, sum(w)::bigint as scored_embryos, sum(w * m) / sum(w) as raw from (select gene_id as focal, embryo_id, avg(score) as m, count(*) as cells from f where score is not null group by 1, 2) join w using (embryo_id) where w > 0 group by 1, 2),
p as (select draw, focal, peer, bool_and(complete) as complete, bool_or(positive) as positive, sum(w * m) / sum(w) as m from e join w using (embryo_id) where w > 0 group by 1, 2, 3),
n as (select draw, focal, count(*) as matched, count(*) filter (positive) as positive, avg(m) as nm, stddev_samp(m) as sd from p where complete group by 1, 2),
a as (select dd.draw, b.gene_id as focal, b.bin, coalesce(scored_cells, 0) as scored_cells, coalesce(scored_embryos, 0) as scored_embryos, coalesce((select count(*) - 1 from b c where c.bin = b.bin), 0) as candidates, coalesce(matched, 0) as matched, coalesce(positive, 0) as positive, raw, nm, sd
from (select distinct draw from w) dd cross join b left join o on o.draw = dd.draw and o.focal = b.gene_id left join n on n.draw = dd.draw and n.focal = b.gene_id),
r as (select *, case when scored_embryos = 0 then 'no_focal_scored_cells' when bin is null then 'unavailable_sparse_dropout_band' when matched < 2 then 'fewer_than_two_matched_peers' when coalesce(sd, 0) < 1e-12 then 'zero_or_nonfinite_null_variance' end as reason from a)
select draw, focal, scored_cells, scored_embryos, case when candidates < 0 then 0 else candidates end as candidates, matched, positive, round(raw, 6) as raw, reason, case when reason is null then round((raw - nm) / sd, 4) end as z from r""")
def redrawn_peer_null(spark, d):
    facts = _facts(spark, d)
    w = read(spark, d, "nation").select(F.col("n_nationkey").alias("embryo_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("draw"))
    w = w.withColumn("w", F.expr("(embryo_id * (draw + 3) + draw) % 3"))
    out = evidence.redrawn_null(facts, _bins(facts), w)
    return out.select("draw", "focal", "scored_cells", "scored_embryos", "candidates", "matched", "positive", F.round("raw", 6).alias("raw"), "reason", F.round("z", 4).alias("z"))


_DRAWS = "w as (select d as draw, n_nationkey % 2 as side, n_nationkey as embryo_id, case when (n_nationkey * (d + 3) + d) % 4 >= 2 then 1 else 0 end as w from nation, (select unnest(range(0, 40)) as d))"
_SUPPORT = "s as (select distinct s_nationkey % 2 as side, l_partkey as gene_id, s_nationkey as embryo_id from lineitem join supplier on s_suppkey = l_suppkey where l_quantity > 10)"
_OCCUPIED = f"""{_DRAWS}, {_SUPPORT}, h as (select draw, side, gene_id, max(w) as hit from s join w using (side, embryo_id) group by 1, 2, 3), o as (select draw, side, count(*) filter (hit = 0) as missing, count(*) filter (hit = 0) = 0 as supported from h group by 1, 2)"""


def _occupied(spark, d):
    w = read(spark, d, "nation").select((F.col("n_nationkey") % 2).alias("side"), F.col("n_nationkey").alias("embryo_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw"))
    w = w.withColumn("w", F.expr("if((embryo_id * (draw + 3) + draw) % 4 >= 2, 1, 0)"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("embryo_id"))
    held = read(spark, d, "lineitem").where("l_quantity > 10").select("l_suppkey", F.col("l_partkey").alias("gene_id")).join(s, "l_suppkey").select((F.col("embryo_id") % 2).alias("side"), "gene_id", "embryo_id")
    return evidence.occupancy(held.distinct(), w)


@query(f"with {_OCCUPIED} select * from o")
def draw_occupancy(spark, d):
    return _occupied(spark, d)


@query(f"with {_OCCUPIED}, j as (select draw, bool_and(supported) as ok from o group by 1) select count(*) as draws, count(*) filter (ok) as joint, 20 * count(*) filter (ok) >= 19 * count(*) as floor_met from j")
def bootstrap_feasibility(spark, d):
    return evidence.feasible(_occupied(spark, d))


@query("""with t as (select l_suppkey as cell_id, s_nationkey as embryo_id, p_brand as gene_id, row_number() over (partition by l_suppkey order by min(l_orderkey * 10 + l_linenumber), p_brand) as pos from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
b as (select distinct p_brand as gene_id, case when p_brand not like '%#5%' then substr(p_brand, 1, 7) end as bin from part), k as (select * from t where pos <= 20), e as (select cell_id, count(*) as n from k group by 1),
f as (select k.* from k join e using (cell_id) where pos <= n - case when n = 20 then 2 else 1 end), h as (select gene_id, count(*) as cells, count(distinct embryo_id) as embryos from f group by 1), g as (select f.*, bin from f join b using (gene_id) where bin is not null),
q as (select x.gene_id, y.gene_id as peer, count(*) as n from g x join g y on x.cell_id = y.cell_id and x.bin = y.bin and x.gene_id <> y.gene_id group by 1, 2), p as (select gene_id, least(2, count(*)) as peers from q join h using (gene_id) where n = cells group by 1),
r as (select b.gene_id, bin, coalesce((select count(*) from k where k.gene_id = b.gene_id), 0) as attempts, coalesce(cells, 0) as cells, coalesce(embryos, 0) as embryos, coalesce(peers, 0) as peers from b left join h on h.gene_id = b.gene_id left join p on p.gene_id = b.gene_id)
select gene_id, attempts, cells, embryos, peers, case when cells = 0 then 'no_potentially_scorable_cells' when bin is null then 'unavailable_sparse_dropout_band' when peers < 2 then 'fewer_than_two_potential_matched_peers' end as failure from r""")
def support_upper_bound(spark, d):
    from pyspark.sql import Window

    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("embryo_id"))
    first = l.join(p, "l_partkey").join(s, "l_suppkey").groupBy(F.col("l_suppkey").alias("cell_id"), "embryo_id", "gene_id").agg(F.min("place").alias("place"))
    rows = first.withColumn("pos", F.row_number().over(Window.partitionBy("cell_id").orderBy("place", "gene_id")))  # a sentence is a cell
    bins = p.select("gene_id").distinct().withColumn("bin", F.when(~F.contains("gene_id", F.lit("#5")), F.substring("gene_id", 1, 7)))
    return evidence.potential_support(rows, bins, 20)


@query("select count(*) as groups, count(*) filter (abs(p - w) > 1e-12 * greatest(1, abs(p))) as apart from (select l_partkey, avg(l_quantity) as p, sum(l_quantity * 1) / sum(1) as w from lineitem group by 1)")
def unit_weight_identity(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_quantity", F.lit(1).alias("w"))
    return evidence.unit_weights(l, ["l_partkey"], "l_quantity", "w")


_NAMES = """n as (select c_nationkey // 5 as species, c_nationkey as file, case when c_custkey % 3 = 0 then 'run_' || c_nationkey || '_AC' || c_custkey % 211 || '-1' else 'AC' || c_custkey % 211 end as name from customer),
k as (select distinct species, file, 'raw' as kind, name from n union select distinct species, file, 'normal', regexp_replace(regexp_replace(name, '^run_\\d+_', ''), '-\\d+$', '') from n),
s as (select x.species, x.file as a, y.file as b, count(*) filter (x.kind = 'raw') as raw, count(*) filter (x.kind = 'normal') as normal from k x join k y on x.species = y.species and x.kind = y.kind and x.name = y.name and x.file < y.file group by 1, 2, 3),
f as (select distinct species, file from n), v as (select f.species, f.file as a, g.file as b, coalesce(raw, 0) as raw, coalesce(normal, 0) as normal from f join f g on f.species = g.species and f.file < g.file left join s on s.species = f.species and s.a = f.file and s.b = g.file),
o as (select *, case when raw > 12 or normal > greatest(raw, 12) then 'FAIL' when raw > 0 or normal > raw then 'WARN' else 'PASS' end as level from v)"""


def _overlaps(spark, d):
    name = "if(c_custkey % 3 = 0, concat('run_', c_nationkey, '_AC', c_custkey % 211, '-1'), concat('AC', c_custkey % 211))"
    c = read(spark, d, "customer").select(F.expr("c_nationkey div 5").alias("species"), F.col("c_nationkey").alias("file"), F.expr(name).alias("name"))
    return reports.overlaps(c, identifiers.barcode(F.col("name")), 12)


@query(f"with {_NAMES} select * from o")
def file_overlaps(spark, d):
    return _overlaps(spark, d)


@query(f"with {_NAMES} select species, count(*) as findings, case max(case level when 'FAIL' then 2 when 'WARN' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as level from o group by 1")
def worst_levels(spark, d):
    return reports.worst(_overlaps(spark, d), ["species"], "level")


@query("""with p as (select l_orderkey as accession, l_partkey as gene from lineitem where l_linenumber = 1 union all select l_orderkey, l_partkey + 1 from lineitem where l_linenumber = 1 and l_orderkey % 9 = 0), g as (select p_partkey as gene, p_brand || p_size as key from part),
s as (select accession, min(gene) as gene from p group by 1 having count(distinct gene) = 1), c as (select key, count(distinct gene) as n from g join (select distinct gene from s) using (gene) group by 1), q as (select p_brand || p_size as key from part union select p_brand || 'x' || p_size from part)
select q.key, case when n > 1 then 'ambiguous' when n = 1 then 'covered' when q.key in (select key from g) then 'without_protein' else 'absent' end as status from q left join c on c.key = q.key""")
def multi_hop_bridge(spark, d):
    l = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("accession"), F.col("l_partkey").alias("gene"))
    p = read(spark, d, "part")
    size = F.col("p_size").cast("string")
    genes = p.select(F.col("p_partkey").alias("gene"), F.concat("p_brand", size).alias("key"))
    probe = genes.select("key").union(p.select(F.concat("p_brand", F.lit("x"), size)))
    return reports.probe_bridge(l.union(l.where("accession % 9 = 0").select("accession", F.col("gene") + 1)), genes, probe)


_INDEX = """x as (select p_partkey % 700 as gid, trim(name) as name from (select p_partkey, unnest(list_append(string_split(case when p_partkey % 4 = 0 then '-' else p_brand || '|' || p_name || '| ' || p_type || p_size end, '|'), 'S' || p_partkey)) as name from part)),
i as (select name, min(gid) as gid from x where name not in ('', '-') group by 1 having count(distinct gid) = 1)"""


def _index(spark, d):
    said = F.when(F.col("p_partkey") % 4 == 0, "-").otherwise(F.concat("p_brand", F.lit("|"), "p_name", F.lit("| "), "p_type", F.col("p_size").cast("string")))
    return reports.name_index(read(spark, d, "part").select((F.col("p_partkey") % 700).alias("gid"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("symbol"), said.alias("synonyms")))


@query(f"""with {_INDEX}, k as (select p_partkey as at, 'L' || p_partkey || ':' || case p_partkey % 4 when 0 then 'none' when 1 then 'Sp-S' || p_partkey when 2 then replace(p_name, ' ', '_') else p_name end as key from part),
v as (select key, s, t, case t when 0 then s when 1 then case when starts_with(s, 'Sp-') then substr(s, 4) end else replace(s, '_', ' ') end as name from (select key, substr(key, strpos(key, ':') + 1) as s, unnest([0, 1, 2]) as t from k) where s <> 'none')
select key, gid, t as tried from (select key, gid, t, row_number() over (partition by key order by t, gid) as r from v join i using (name)) where r = 1""")
def name_variants(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    suffix = F.when(F.col("p_partkey") % 4 == 0, "none").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Sp-S"), k)).when(F.col("p_partkey") % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    return reports.by_variants(p.select(F.concat(F.lit("L"), k, F.lit(":"), suffix).alias("key")), _index(spark, d))


@query("""with t as (select l_partkey as gid, l_suppkey as partner, count(*) as tools from lineitem group by 1, 2), c as (select gid, partner from (select gid, partner, row_number() over (partition by gid order by tools desc, partner) as r from t where tools >= 3) where r = 1),
o as (select l_partkey as gid, min(l_suppkey) as partner from lineitem where l_quantity > 48 group by 1 having count(distinct l_suppkey) = 1) select gid, partner, 'consensus' as route from c union all select gid, partner, 'only_candidate' from o anti join c using (gid)""")
def consensus_partners(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_partkey").alias("gid"), F.col("l_suppkey").alias("partner"), "l_quantity")
    return reports.partners(l.groupBy("gid", "partner").agg(F.count("*").alias("tools")), l.where("l_quantity > 48").select("gid", "partner"))


@query("""with m as (select l_orderkey as level, case when l_linenumber % 2 = 1 then 'a' else 'b' end as side, l_partkey % 60 as gene from lineitem where l_linenumber <= 4), s as (select level, min(gene) filter (side = 'a') as a, min(gene) filter (side = 'b') as b from m group by 1 having count(distinct case when side = 'a' then gene end) = 1 and count(distinct case when side = 'b' then gene end) = 1),
z as (select a, b, min(level) as level from s group by 1, 2), p as (select o_orderkey as id, o_custkey % 60 as a, o_orderkey % 70 as b from orders)
select id, case when z.level is not null then 'concordant' when p.a in (select gene from m where side = 'a') and p.b in (select gene from m where side = 'b') then 'discordant' else 'unavailable' end as verdict, z.level from p left join z on z.a = p.a and z.b = p.b""")
def crosscheck_verdicts(spark, d):
    l = read(spark, d, "lineitem").where("l_linenumber <= 4")
    members = l.select(F.col("l_orderkey").alias("level"), F.when(F.col("l_linenumber") % 2 == 1, "a").otherwise("b").alias("side"), (F.col("l_partkey") % 60).alias("gene"))
    pairs = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("a"), (F.col("o_orderkey") % 70).alias("b"))
    return reports.group_verdicts(pairs, members)


@query(f"""with {OBS_SQL} select embryo_id, count(*) as n, sha256('[' || string_agg('{{"cell_id":' || cell_id || ',"species":"' || species || '","phase":"' || phase || '"}}', ',' order by cell_id) || ']') as digest from obs group by 1""")
def cohort_digests(spark, d):
    return reports.cohort_digest(obs(spark, d), ["embryo_id"], "cell_id", ["species", "phase"])


@query(f"""with {OBS_SQL}, r as (select species, phase, cell_id % 7 <> 0 as e, cell_id % 7 <> 0 and cell_id % 5 <> 1 as t, cell_id % 7 <> 0 and cell_id % 5 <> 1 and embryo_id % 3 <> 0 and phase <> 'BUILDING' as p, (cell_id * 7 + embryo_id) % 4 as d from obs),
n as (select species, phase, count(*) as source, count(*) filter (e) as eligible, count(*) filter (t) as train, count(*) filter (p) as pool, count(*) filter (p and d > 0) as sampled, coalesce(sum(d) filter (p), 0)::bigint as draws from r group by 1, 2), w as (select sum(draws) as d, sum(pool) as p from n)
select n.*, source - eligible as qc_excluded, eligible - train as non_train, train - pool as cap_excluded, pool - sampled as unsampled, draws - sampled as repeated, train > 0 and pool = 0 as unrepresented, round(draws / w.d, 6) as draw_fraction, round(pool / w.p, 6) as expected_fraction from n, w""")
def sampling_audit(spark, d):
    train = (F.col("cell_id") % 7 != 0) & (F.col("cell_id") % 5 != 1)
    o = obs(spark, d).select("species", "phase", (F.col("cell_id") % 7 != 0).alias("eligible"), train.alias("train"), (train & (F.col("embryo_id") % 3 != 0) & (F.col("phase") != "BUILDING")).alias("pool"), ((F.col("cell_id") * 7 + F.col("embryo_id")) % 4).alias("draws"))
    return reports.sampler_audit(o, ["species", "phase"]).withColumns({c: F.round(c, 6) for c in ("draw_fraction", "expected_fraction")})


@query(f"""with {OBS_SQL}, s as (select species, count(*) as n_obs, count(distinct phase) as phases, count(*) filter (assay = 'P') as unmapped, count(distinct embryo_id) as embryos from obs group by 1)
select species, n_obs, array_to_string(list_filter([case when phases < 5 then 'too few phases' end, case when unmapped > 0 then 'unmapped stages' end, case when n_obs < 2900 then 'too few cells' end, case when embryos < 4 then 'too few embryos' end], lambda x: x is not null), '; ') as blockers,
not (phases < 5 or unmapped > 0 or n_obs < 2900 or embryos < 4) as ready from s""")
def probe_readiness(spark, d):
    s = obs(spark, d).groupBy("species").agg(F.count("*").alias("n_obs"), F.count_distinct("phase").alias("phases"), F.count_if(F.col("assay") == "P").alias("unmapped"), F.count_distinct("embryo_id").alias("embryos"))
    checks = {"too few phases": F.col("phases") < 5, "unmapped stages": F.col("unmapped") > 0, "too few cells": F.col("n_obs") < 2900, "too few embryos": F.col("embryos") < 4}
    return s.select("species", "n_obs", reports.blockers(checks).alias("blockers")).withColumn("ready", F.col("blockers") == "")


@query("""select case when c not between 0 and 49 or m not between 0 and 49 or p not between 0 and 49 then 'count_out_of_range' when m > c or p > m then 'counts_not_nested' when reason is null and (sd is null or z is null or sd <= 0) then 'available_without_values' when reason is not null and (sd is not null or z is not null) then 'unavailable_with_values' end as problem, count(*) as n
from (select cast(l_quantity as int) as c, cast(l_quantity as int) - l_linenumber + 2 as m, cast(l_quantity as int) - l_linenumber as p, nullif(l_tax, 0.04) as sd, nullif(l_tax, 0.04) as z, case when l_tax = 0.04 or l_discount = 0.05 then 'r' end as reason from lineitem) group by 1""")
def observed_row_domain(spark, d):
    q = F.col("l_quantity").cast("int")
    tax = F.nullif(F.col("l_tax"), F.lit(0.04))
    row = {"candidates": q, "matched": q - F.col("l_linenumber") + 2, "positive": q - F.col("l_linenumber"), "raw": F.col("l_tax"), "mean": tax, "sd": tax, "z": tax, "reason": F.when((F.col("l_tax") == 0.04) | (F.col("l_discount") == 0.05), "r")}
    return read(spark, d, "lineitem").groupBy(reports.domain_problem(row, 50).alias("problem")).agg(F.count("*").alias("n"))


@query("""with p as (select l_suppkey as file, l_partkey % 900 as row, l_returnflag as split from lineitem), r as (select file, split, count(*) - case when file % 10 = 0 then 1 else 0 end as n from p group by 1, 2), z as (select s_suppkey as file, 850 + s_suppkey % 100 as rows from supplier),
g as (select p.file, row, count(*) as times, any_value(rows) as rows from p left join z using (file) group by 1, 2)
select file, null::varchar as split, case when rows is null or row < 0 or row >= rows then 'outside' else 'repeated' end as problem, count(*) as n from g where rows is null or row < 0 or row >= rows or times > 1 group by 1, 2, 3
union all select z.file, null, 'not_planned', rows - coalesce(seen, 0) from z left join (select file, count(*) as seen from g where row >= 0 and row < rows group by 1) s using (file) where rows - coalesce(seen, 0) > 0
union all select file, split, 'count_differs', a.n - r.n from (select file, split, count(*) as n from p group by 1, 2) a join r using (file, split) where a.n <> r.n""")
def recorded_plan(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 900).alias("row"), F.col("l_returnflag").alias("split"))
    told = p.groupBy("file", "split").agg((F.count("*") - F.when(F.first("file") % 10 == 0, 1).otherwise(0)).alias("n"))
    return reports.plan_problems(p, told, read(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (850 + F.col("s_suppkey") % 100).alias("rows")))


@query("""with b as (select l_orderkey, 'gene_id=G' || min(l_suppkey) as g, string_agg('transcript_id=T' || l_partkey || case when l_linenumber % 2 = 0 then '.' || l_linenumber else '' end || ';protein_id=P' || l_suppkey || chr(10), '' order by l_linenumber) as t from lineitem group by 1),
c as (select 'G' || regexp_extract(g, 'G(\\d+)', 1) as gene, list_distinct(regexp_extract_all(t, 'transcript_id=([a-zA-Z0-9]+(?:\\.[0-9]+)?)', 1)) as x, list_distinct(regexp_extract_all(t, 'protein_id=([a-zA-Z0-9]+)', 1)) as y from b)
select gene, transcript, unnest(y) as protein from (select gene, unnest(x) as transcript, y from c)""")
def block_products(spark, d):
    l = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.expr("concat('transcript_id=T', l_partkey, if(l_linenumber % 2 = 0, concat('.', l_linenumber), ''), ';protein_id=P', l_suppkey)").alias("line"))
    b = l.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("g"), F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))).alias("x"))
    return reports.block_products(b.select(F.concat(F.lit("gene_id=G"), F.col("g").cast("string"), F.lit("\n"), F.array_join("x.line", "\n")).alias("block")))


@query("""with c as (select o_orderkey as cell_id from orders order by 1 limit 500), g as (select p_partkey as gene_id from part order by 1 limit 100), b as (select cell_id, gene_id, sum(l_quantity) as v from lineitem join c on cell_id = l_orderkey join g on gene_id = l_partkey group by 1, 2),
s as (select (select count(*) from c) as r, (select count(*) from g) as k, (select count(*) from b) as n, (select min(v) from b) as lo, (select max(v) from b) as hi)
select r as n_rows, k as n_cols, case when n = r * k then lo else least(coalesce(lo, 0), 0) end as min_value, case when n = r * k then hi else greatest(coalesce(hi, 0), 0) end as max_value, coalesce((select bool_and(abs(v - round(v)) < 1e-6) from b), true) as integer_valued, coalesce(lo, 0) >= 0 as all_nonnegative from s""")
def matrix_block(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("count"))
    return reports.matrix_block(e, read(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), read(spark, d, "part").select(F.col("p_partkey").alias("gene_id")), 500, 100)


@query("""with e as (select vec_id as id, label as section, embedding::double[] as v, embedding[1:2]::double[] as xy from embeddings),
k as (select a.id, b.id as j, a.section, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as r, row_number() over (partition by a.id order by list_distance(a.xy, b.xy), b.id) as q from e a join e b on a.section = b.section and a.id <> b.id),
n as (select section, count(*) as n from e group by 1), m as (select id, count(*) filter (r <= 5 and q <= 5) as same from k group by 1)
select section, any_value(n) as n, round(avg(coalesce(same, 0) / least(5, n - 1)), 6) as consistency from e join n using (section) left join m using (id) group by 1""")
def neighbourhood_consistency(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("section"), F.col("embedding").alias("v"))
    near = vectors.knn(e, 5, by="section")
    flat = vectors.knn(e.withColumn("v", F.slice("v", 1, 2)), 5, by="section")
    return reports.neighbourhood_consistency(near, flat, e.select("id", "section"), 5).withColumn("consistency", F.round("consistency", 6))
