"""More registered queries: vocabularies, gates, audits, bridges and peer evidence, each over whole tables with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import audits, bridges, nulls, tokens, vectors
from cellweave.plans.registry import query
from cellweave.sources.tables import EXPR_SQL, OBS_SQL, expr, obs, read


@query("select p_partkey as id, p_brand as label, 'rna' as assay, p_size from part")
def projected_fields(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    return audits.project(p, {"label": "p_brand", "assay": "=rna", "p_size": "=kept"}).select("id", "label", "assay", "p_size")


@query("select case o_orderstatus when 'O' then 'early' when 'F' then 'late' else 'middle' end as stage, count(*) as n from orders group by 1")
def strict_stage_map(spark, d):
    return read(spark, d, "orders").groupBy(audits.strict_map(F.col("o_orderstatus"), {"O": "early", "F": "late", "P": "middle"}).alias("stage")).agg(F.count("*").alias("n"))


@query("select case when c_custkey % 33 < 16 then 'v1' when c_custkey % 33 > 16 then 'v2' end as version, count(*) as n from customer group by 1")
def donor_versions(spark, d):
    donor = F.concat(F.lit("TSP"), (F.col("c_custkey") % 33).cast("string"))
    return read(spark, d, "customer").groupBy(audits.donor_version(donor).alias("version")).agg(F.count("*").alias("n"))


@query(f"with {EXPR_SQL} select gene_id from expr group by 1 having sum(count) >= 700")
def genes_above_total(spark, d):
    return audits.genes_with_total(expr(spark, d), 700)


@query("""select o_orderkey as id, o_custkey % 2 = 0 and o_orderkey % 3 <> 0 and lower(o_orderstatus) in ('o', 'p') as wanted from orders""")
def organism_gate(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    primary = F.array(F.col("o_custkey") % 2 == 0)
    organisms = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderstatus", F.lit("x"))).otherwise(F.array("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), audits.one_organism(primary, organisms, ["O", "P"]).alias("wanted"))


_STATUS = "case when l_linenumber = 1 then 'scored' else 'unscored' end"
_VALUE = "case when l_quantity > 10 then l_discount end"


@query(f"""select problem, count(*) as n from (select case when s = 'scored' and not (n > 0 and v is not null) then 'scored_without_value' when s <> 'scored' and not (n = 0 and v is null) then 'value_without_score' end as problem
from (select {_STATUS} as s, case when l_quantity > 20 then 1 else 0 end as n, {_VALUE} as v from lineitem)) group by 1""")
def row_status_violations(spark, d):
    l = read(spark, d, "lineitem").select(F.expr(_STATUS).alias("s"), F.expr("if(l_quantity > 20, 1, 0)").alias("n"), F.expr(_VALUE).alias("v"))
    return l.groupBy(audits.row_status(F.col("s"), F.col("n"), F.col("v")).alias("problem")).agg(F.count("*").alias("n"))


@query("""select count(*) filter (l_discount between 0 and 0.05) as in_range, count(*) filter (l_extendedprice >= 0) as nonnegative, count(*) filter (isfinite(l_tax)) as finite, count(*) as total from lineitem""")
def range_predicates(spark, d):
    finite = ~F.isnan("l_tax") & (F.abs("l_tax") < float("inf"))
    return read(spark, d, "lineitem").agg(F.count_if(F.col("l_discount").between(0, 0.05)).alias("in_range"), F.count_if(F.col("l_extendedprice") >= 0).alias("nonnegative"), F.count_if(finite).alias("finite"), F.count("*").alias("total"))


@query("""select case when o_orderkey % 5 = 0 then 'ineligible_source_rna_qc_fail' when o_orderpriority like '1%' then 'ineligible_mixed_embryo_label' else 'pending' end as status, o_orderstatus as stage, count(*) as n from orders group by 1, 2""")
def holdout_cascade(spark, d):
    name = F.when(F.startswith("o_orderpriority", F.lit("1")), F.lit("day3_EmbryoMixed_1")).otherwise("day3")
    o = read(spark, d, "orders")
    return o.groupBy(audits.holdout_status(F.col("o_orderkey") % 5 != 0, name).alias("status"), F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("n"))


@query("""with v as (select l_partkey as token, min(l_orderkey * 10 + l_linenumber) as place from lineitem group by 1), s as (select l_partkey as token from lineitem where false)
select 'P' || token as token, row_number() over (order by place, 'P' || token) - 1 + 2 as position from v union all select '<pad>', 0 union all select '<unk>', 1""")
def vocabulary_positions(spark, d):
    l = read(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("token"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return tokens.positions(l, ["<pad>", "<unk>"])


@query("""select l_orderkey as cell_id, l_linenumber as pos, coalesce(position, 1) as position from lineitem left join (select p_partkey, p_partkey * 2 as position from part where p_size > 20) on p_partkey = l_partkey""")
def token_lookup(spark, d):
    vocab = read(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("token"), (F.col("p_partkey") * 2).alias("position"))
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("pos"), "l_partkey")
    return tokens.lookup(l, vocab, "l_partkey", 1).select("cell_id", "pos", "position")


_SENTENCE = """with e as (select l_orderkey as cell_id, l_partkey as token, l_linenumber as pos, case when l_quantity < 8 then 0 else l_quantity end as count from lineitem),
r as (select *, row_number() over (partition by cell_id order by count <= 0, {order}, pos, token, least(30, count)) as r from e), k as (select * from r where r <= 4)
select cell_id, string_agg(cast(token as varchar), ' ' order by r) || repeat(' 0', cast(4 - count(*) as int)) as tokens, string_agg(cast(cast(least(30, count) as int) as varchar), ' ' order by r) || repeat(' 0', cast(4 - count(*) as int)) as counts,
4 - count(*) as n_masked from k group by cell_id"""


def _sentences(spark, d, by_count):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("token"), F.col("l_linenumber").alias("pos"), F.expr("if(l_quantity < 8, 0D, l_quantity)").alias("count"))
    s = tokens.sentences(e, 4, 30.0, 0, by_count)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")
    return s.select("cell_id", text("tokens").alias("tokens"), text("counts").alias("counts"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_masked"))


@query(_SENTENCE.format(order="0"))
def cell_sentences(spark, d):
    return _sentences(spark, d, False)


@query(_SENTENCE.format(order="case when count > 0 then -count else 0 end"))
def cell_sentences_by_count(spark, d):
    return _sentences(spark, d, True)


@query("""with s as (select o_orderkey as place, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as stage, o_custkey as sample from orders where o_orderkey % 13 <> 0)
select coalesce(o_orderkey, place) as place, case when place is null then 'missing_in_sidecar' else 'differs' end as problem from orders full join s on o_orderkey = place where place is null or o_orderstatus <> stage""")
def positional_join_problems(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("stage"), F.col("o_custkey").alias("sample"))
    side = o.where("place % 13 <> 0").withColumn("stage", F.when(F.col("place") % 11 == 0, "X").otherwise(F.col("stage")))
    return audits.positional_mismatches(o, side, "place", ["sample", "stage"])


@query(f"""with {OBS_SQL}, a as (select species, phase, count(*) as n from obs group by 1, 2), b as (select species, phase, count(*) as n from obs where cell_id % 3 = 0 group by 1, 2),
c as (select species, phase, count(*) as n from obs where cell_id % 50 = 1 group by 1, 2)
select species, phase, a.n as available, coalesce(b.n, 0) as drawn, coalesce(c.n, 0) as skipped, round(coalesce(b.n, 0) / a.n, 6) as draw_fraction from a left join b using (species, phase) left join c using (species, phase)""")
def sampler_reconciliation(spark, d):
    o = obs(spark, d)
    count = lambda rows: rows.groupBy("species", "phase").agg(F.count("*").alias("n"))
    r = audits.reconcile({"available": count(o), "drawn": count(o.where("cell_id % 3 = 0")), "skipped": count(o.where("cell_id % 50 = 1"))}, ["species", "phase"])
    return r.withColumn("draw_fraction", F.round(F.try_divide("drawn", "available"), 6))


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counters(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""select nation as group_id, count(*) as n, sha256('["' || string_agg(k, '","' order by k) || '"]') as digest from (select distinct s_nationkey as nation, cast(s_suppkey as varchar) as k from supplier) group by 1""")
def membership_digests(spark, d):
    return audits.set_digest(read(spark, d, "supplier").select(F.col("s_nationkey").alias("group_id"), "s_suppkey"), ["group_id"], "s_suppkey")


@query("select p_type as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def top_values(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10)


@query("""with s as (select l_shipmode as species, sum(l_extendedprice::decimal(20,6) * l_linenumber) as b, sum((l_extendedprice * (1 + l_discount - 0.05))::decimal(20,6) * l_linenumber) as c from (select l_suppkey % 7 as l_shipmode, l_extendedprice, l_discount, l_linenumber from lineitem) group by 1)
select species, round(((b - c) / abs(b))::double, 4) as gain, (b - c) / abs(b) < -0.02 as vetoed from s""")
def candidate_improvement(spark, d):
    l = read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("species"), F.col("l_extendedprice").alias("base"), (F.col("l_extendedprice") * (1 + F.col("l_discount") - 0.05)).alias("candidate"), "l_linenumber")
    return audits.relative_improvement(l, "species", "base", "candidate", "l_linenumber").withColumn("gain", F.round(F.col("gain").cast("double"), 4))


@query("""select l_returnflag as stratum, round(avg(m), 6) as mean, count(m) as evaluable, count(*) - count(m) as not_evaluable from (select l_returnflag, l_suppkey as g, avg(case when l_quantity > 45 then l_discount end) as m from lineitem group by 1, 2) group by 1""")
def evaluable_means(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("stratum"), "l_suppkey", F.when(F.col("l_quantity") > 45, F.col("l_discount")).alias("v"))
    return audits.evaluable_mean(l, ["stratum"], "l_suppkey", "v").withColumn("mean", F.round("mean", 6))


@query("""with s as (select c_nationkey as nation, count(*) as joined, count(*) filter (c_acctbal > -800) as paired from customer group by 1) select nation, paired, joined, paired >= 5 and 5 * paired >= 4 * joined as reported from s""")
def reporting_floors(spark, d):
    s = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("joined"), F.count_if(F.col("c_acctbal") > -800).alias("paired"))
    return s.select("nation", "paired", "joined", audits.floors(F.col("paired"), F.col("paired"), F.col("joined"), 5).alias("reported"))


@query("""with s as (select n_nationkey as nation, count(c_custkey) as all_a, count(c_custkey) filter (c_acctbal > 0) as mapped_a from nation left join customer on c_nationkey = n_nationkey group by 1),
t as (select n_nationkey as nation, count(s_suppkey) as all_b, count(s_suppkey) filter (s_acctbal > 0) as mapped_b from nation left join supplier on s_nationkey = n_nationkey group by 1)
select nation, case when all_a * all_b = 0 then 'unevaluable' when mapped_a / all_a >= 0.6 and mapped_b / all_b >= 0.6 and mapped_a >= 3 then 'eligible' else 'below_floor' end as status from s join t using (nation)""")
def ortholog_eligibility(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("all_a"), F.count_if(F.col("c_acctbal") > 0).alias("mapped_a"))
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("all_b"), F.count_if(F.col("s_acctbal") > 0).alias("mapped_b"))
    status = audits.eligibility(F.col("mapped_a"), F.col("all_a"), F.col("mapped_b"), F.col("all_b"), F.col("mapped_a"), 0.6, 3)
    return n.join(c, "nation", "left").join(s, "nation", "left").select("nation", status.alias("status"))


@query("""with s as (select l_partkey as gene, l_suppkey % 5 as sp, avg(case when l_discount > 0.03 then l_quantity end) as v, case when max(l_tax) > 0.06 then 'scored' else 'skipped' end as st from lineitem group by 1, 2), p as (select p_partkey as a, p_partkey + 1 as b from part)
select case when x.st is null or y.st is null then 'missing' when x.st <> 'scored' or y.st <> 'scored' then 'unavailable' when x.v is null or y.v is null then 'nonfinite' end as reason, count(*) as n
from p left join (select * from s where sp = 1) x on x.gene = p.a left join (select * from s where sp = 2) y on y.gene = p.b group by 1""")
def ortholog_pair_status(spark, d):
    l = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 5).alias("sp"))
    s = l.agg(F.avg(F.when(F.col("l_discount") > 0.03, F.col("l_quantity"))).alias("v"), F.when(F.max("l_tax") > 0.06, "scored").otherwise("skipped").alias("st"))
    side = lambda sp, key: s.where(F.col("sp") == sp).select(F.col("gene").alias(key), F.col("v").alias(f"v_{key}"), F.col("st").alias(f"st_{key}"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    met = p.join(side(1, "a"), "a", "left").join(side(2, "b"), "b", "left")
    return met.groupBy(audits.pair_status(F.col("v_a"), F.col("v_b"), F.col("st_a"), F.col("st_b")).alias("reason")).agg(F.count("*").alias("n"))


@query("""select grp, count(*) as required, count(have) as covered, coalesce(string_agg(cast(k as varchar), ',' order by k) filter (have is null and r <= 5), '') as missing from
(select q.grp, q.k, c.k as have, row_number() over (partition by q.grp, c.k is null order by q.k) as r from (select p_size as grp, p_partkey as k from part) q left join (select distinct l_partkey as k from lineitem where l_quantity > 48) c on q.k = c.k) group by 1""")
def required_gene_coverage(spark, d):
    required = read(spark, d, "part").select(F.col("p_size").alias("grp"), F.col("p_partkey").alias("k"))
    covered = read(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k")).distinct()
    return audits.coverage_gap(required, required.join(covered, "k", "left_semi"), "grp", "k", 5)


@query("""with u as (select i as index, (('0x' || substr(sha256('7:modality:' || i), 1, 12))::bigint) / 281474976710656.0 as u, (('0x' || substr(sha256('7:row:' || i), 1, 12))::bigint) / 281474976710656.0 as v from (select unnest(range(0, 4000)) as i))
select index, case when u < 0.7 then 'cells' else 'spatial' end as modality, cast(floor(v * case when u < 0.7 then 2000 else 300 end) as bigint) as row from u""")
def modality_mixing(spark, d):
    return audits.modality_mix({"cells": 2000, "spatial": 300}, {"cells": 0.7, "spatial": 0.3}, 7, spark)


@query("""with r as (select o_orderpriority as label, o_orderkey as id, row_number() over (partition by o_orderpriority order by sha256('5:' || o_orderkey), o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders)
select label, id, r <= case when n < 2 then 0 else greatest(1, least(n - 1, floor(n * 0.3 + 0.5))) end as test from r""")
def stratified_test_split(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"))
    return audits.stratified_test(o, "label", "id", 0.3, 5)


@query("select id from (select distinct l_partkey || '-' || l_suppkey as id from lineitem) order by sha256('11:' || id) limit 200")
def crosscheck_sample(spark, d):
    p = read(spark, d, "lineitem").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("id")).distinct()
    return p.orderBy(F.sha2(F.concat(F.lit("11:"), "id"), 256)).limit(200)


@query("""select min(l_orderkey) as key, l_partkey * 50 + l_linenumber as target from lineitem group by l_partkey * 50 + l_linenumber having count(distinct l_orderkey) = 1""")
def collision_free_translation(spark, d):
    return bridges.translate(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") * 50 + F.col("l_linenumber")).alias("target")))


@query("""with a as (select o_orderkey as symbol, o_custkey as gene from orders), b as (select o_orderkey as symbol, case when o_orderkey % 3 = 0 then o_custkey + 1 else o_custkey end as gene from orders union all select o_orderkey, 0 from orders where o_orderkey % 5 = 0)
select symbol, gene from a where symbol in (select symbol from b group by 1 having count(distinct gene) = 1) and (symbol, gene) in (select symbol, gene from b)""")
def agreed_symbols(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_custkey").alias("gene"))
    other = o.select("symbol", F.when(F.col("symbol") % 3 == 0, F.col("gene") + 1).otherwise(F.col("gene")).alias("gene")).union(o.where("symbol % 5 = 0").select("symbol", F.lit(0).cast("long")))
    return bridges.agreed(o, other)


@query("""with o as (select distinct o_orderkey as id, o_orderkey // 3 as accession from orders where o_orderkey % 17 <> 0 union select o_orderkey, o_orderkey // 3 + 1 from orders where o_orderkey % 19 = 0),
w as (select distinct l_orderkey // 3 as accession, l_partkey * 1000 + l_suppkey * 7 + l_orderkey % 50 as gene from lineitem where l_linenumber = 1 or l_linenumber = 2 and l_orderkey % 4 = 0),
a as (select id, count(*) as n_old, min(accession) as accession from o group by 1), b as (select accession, count(*) as n_ids from o group by 1), c as (select accession, count(*) as n_new, min(gene) as gene from w group by 1), g as (select gene, count(*) as n_acc from w group by 1),
r as (select case when n_old is null then 'no_old' when n_old > 1 then 'multiple_old' when n_ids > 1 then 'shared_old' when n_new is null then 'no_new' when n_new > 1 then 'multiple_new' when n_acc > 1 then 'shared_new' end as reason
from orders left join a on a.id = o_orderkey left join b using (accession) left join c using (accession) left join g using (gene)) select reason, count(*) as n from r group by 1""")
def id_bridge_cascade(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    old = o.where("id % 17 <> 0").select("id", F.expr("id div 3").alias("accession")).union(o.where("id % 19 = 0").select("id", F.expr("id div 3 + 1")))
    l = read(spark, d, "lineitem").where("l_linenumber = 1 or l_linenumber = 2 and l_orderkey % 4 = 0")
    new = l.select(F.expr("l_orderkey div 3").alias("accession"), F.expr("l_partkey * 1000 + l_suppkey * 7 + l_orderkey % 50").alias("gene"))
    return bridges.cascade(o, old, new).groupBy("reason").agg(F.count("*").alias("n"))


@query("""with h as (select o_custkey as query, case when o_orderkey % 6 = 0 then o_custkey else -1 end as symbol, o_orderkey % 200 as gene from orders), v as (select p_partkey as gene from part where p_size > 15),
s as (select query, list(distinct h.gene) filter (v.gene is not null and symbol = query) as e, list(distinct h.gene) filter (v.gene is not null) as k from h left join v on v.gene = h.gene group by 1),
g as (select query, case when coalesce(len(e), 0) > 0 then e else k end as g from s) select query, case when len(g) = 1 then g[1] end as gene, case when coalesce(len(g), 0) = 0 then 'not_in_vocab' when len(g) = 1 then 'mapped' else 'ambiguous' end as status from g""")
def hit_resolution(spark, d):
    h = read(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_custkey")).otherwise(-1).alias("symbol"), (F.col("o_orderkey") % 200).alias("gene"))
    return bridges.resolve_hits(h, read(spark, d, "part").where("p_size > 15").select(F.col("p_partkey").alias("gene")))


@query("""with p as (select distinct o_orderkey + case when o_orderkey % 4 = 0 then 1 else 0 end as old, o_custkey * 40 + o_orderkey % 40 as new from orders), a as (select old, min(new) as new from p group by 1 having count(*) = 1), b as (select new from p group by 1 having count(*) = 1)
select a.old, a.new, case when h.new is null then 'additional' when h.new = a.new then 'agrees' else 'conflicts' end as status from a semi join b on a.new = b.new
left join (select o_orderkey + case when o_orderkey % 4 = 0 then 1 else 0 end as old, min(case when o_orderkey % 5 = 0 then 0 else o_custkey * 40 + o_orderkey % 40 end) as new from orders where o_orderkey % 3 <> 0 group by 1) h on h.old = a.old""")
def correspondence_audit(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey + if(o_orderkey % 4 = 0, 1, 0)").alias("old"), F.expr("o_custkey * 40 + o_orderkey % 40").alias("new"))
    had = o.where("o_orderkey % 3 <> 0").groupBy("old").agg(F.min(F.expr("if(o_orderkey % 5 = 0, 0, new)")).alias("new"))
    return bridges.audit(o.select("old", "new"), had)


@query("""with n as (select p_partkey, replace(lower(p_type), ' ', '_') || '_gca_' || p_partkey as name from part), s as (select distinct split_part(lower(p_type), ' ', 1) as species from part)
select name, species from n join s on starts_with(name, species || '_')""")
def prefix_matches(spark, d):
    p = read(spark, d, "part")
    names = p.select(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("_gca_"), F.col("p_partkey").cast("string")).alias("name"))
    return bridges.prefix_match(names, p.select(F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1)).alias("species")).distinct())


@query("""select 'orders' as source, o_orderkey as id, o_totalprice as amount, cast(null as bigint) as size from orders union all select 'part', p_partkey, null, p_size from part""")
def frames_by_name(spark, d):
    o = read(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    p = read(spark, d, "part").select(F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("id"), F.lit("part").alias("source"))
    return o.unionByName(p, allowMissingColumns=True)


@query("""select count(*) = 0 as equal, count(*) as n_apart from (select coalesce(a, b) as k from (select distinct l_orderkey as a from lineitem) full join (select distinct o_orderkey as b from orders) on a = b where a is null or b is null)""")
def set_equality(spark, d):
    a, b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    apart = a.join(b, "k", "left_anti").union(b.join(a, "k", "left_anti"))
    return apart.agg((F.count("*") == 0).alias("equal"), F.count("*").alias("n_apart"))


_ZERO = """with f as (select l_suppkey as cell_id, s_nationkey as embryo_id, p_brand || p_type as gene_id, avg(case when l_discount > 0.01 then l_quantity end) as score, true as positive from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
b as (select distinct gene_id, substr(gene_id, 1, 7) as bin from f), fb as (select f.*, bin from f join b using (gene_id)), asked as (select distinct gene_id as focal, cell_id, bin from fb where score is not null),
x as (select a.focal, b.gene_id as peer, a.cell_id from asked a join b on a.bin = b.bin and b.gene_id <> a.focal),
y as (select x.*, f.score, f.positive from x left join f on f.gene_id = x.peer and f.cell_id = x.cell_id)
select focal, count(*) filter (score is not null) as scored, count(*) filter (score is null and positive) as unavailable, count(*) filter (positive is null) as zeros, round(coalesce(sum(score), 0), 4) as total from y group by 1"""


@query(_ZERO)
def measured_zero_peers(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("score"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", "p_type").alias("gene_id"))
    facts = l.join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("cell_id"), "gene_id").agg(F.avg("score").alias("score"))
    peers = nulls.measured_zero(facts, facts.select("gene_id", F.substring("gene_id", 1, 7).alias("bin")).distinct())
    state = lambda s: F.count_if(F.col("state") == s)
    return peers.groupBy("focal").agg(state("scored").alias("scored"), state("unavailable").alias("unavailable"), state("zero").alias("zeros"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


_KNN = """d as (select a.vec_id as id, b.vec_id as neighbour, list_distance(a.embedding::double[], b.embedding::double[]) as distance from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select id, neighbour, r from (select id, neighbour, row_number() over (partition by id order by distance, neighbour) as r from d) where r <= 5)"""


@query(f"""with {_KNN}, l as (select vec_id, label from embeddings), m as (select k.id, avg(case when a.label = b.label then 1.0 else 0.0 end) as share from k join l a on a.vec_id = id join l b on b.vec_id = neighbour group by 1)
select label as phase, count(*) as n, round(avg(share), 6) as same from m join l on vec_id = id group by 1""")
def same_phase_fraction(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("phase"))
    near = vectors.knn(e.select("id", "v"), 5).select("id", "neighbour")
    met = near.join(e.select("id", "phase"), "id").join(e.select(F.col("id").alias("neighbour"), F.col("phase").alias("other")), "neighbour")
    per = met.groupBy("id", "phase").agg(F.avg((F.col("phase").eqNullSafe(F.col("other"))).cast("double")).alias("share"))
    return per.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("same"))


@query("""select count(*) as n, round(max(abs(x - y)), 6) as max_difference, round(avg(abs(x - y)), 6) as mean_difference, round(corr(x, y), 6) as r from (select unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y from embeddings)""")
def embedding_comparison(spark, d):
    e = read(spark, d, "embeddings").select(F.inline(F.arrays_zip(F.col("embedding").cast("array<double>").alias("x"), F.reverse(F.col("embedding").cast("array<double>")).alias("y")))).toDF("x", "y")
    gap = F.abs(F.col("x") - F.col("y"))
    return e.agg(F.count("*").alias("n"), F.round(F.max(gap), 6).alias("max_difference"), F.round(F.avg(gap), 6).alias("mean_difference"), F.round(F.corr("x", "y"), 6).alias("r"))


@query(f"""with {OBS_SQL}, {EXPR_SQL}, s as (select gene_id, embryo_id, avg(count) as a, avg(pos) as b from expr join obs using (cell_id) group by 1, 2) select gene_id, round(avg(a), 6) as mean_count, round(avg(b), 6) as mean_pos, count(*) as n_embryos from s group by 1""")
def covariate_means(spark, d):
    s = expr(spark, d).join(obs(spark, d).select("cell_id", "embryo_id"), "cell_id").groupBy("gene_id", "embryo_id").agg(F.avg("count").alias("a"), F.avg("pos").alias("b"))
    return s.groupBy("gene_id").agg(F.round(F.avg("a"), 6).alias("mean_count"), F.round(F.avg("b"), 6).alias("mean_pos"), F.count("*").alias("n_embryos"))
