"""Registered queries over manifests, sidecars, readiness and published results, each over whole tables with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import identifiers
from cellweave.operators import contracts
from cellweave.plans.registry import query
from cellweave.sources.tables import OBS_SQL, obs, read


@query("""with m as (select p_partkey as id, case p_partkey % 4 when 0 then 'spatial' when 1 then 'single_cell' when 2 then 'bulk' end as t, case when p_size > 20 then p_brand else '' end as s, case when p_partkey % 7 = 0 then ' ' when p_partkey % 7 > 3 then p_type end as sp, case when p_partkey % 5 = 0 then sha256(p_name) when p_partkey % 5 = 1 then upper(sha256(p_name)) end as h from part)
select id, array_to_string(list_filter([case when t is null or t not in ('spatial', 'single_cell') then 'unknown_type' end, case when t = 'spatial' and s = '' then 'spatial_without_section' end, case when trim(sp) = '' then 'blank_species' end, case when not regexp_matches(h, '^[0-9a-f]{64}$') then 'bad_digest' end], lambda x: x is not null), ';') as problems from m""")
def manifest_rules(spark, d):
    k = F.col("p_partkey")
    m = read(spark, d, "part").select(
        k.alias("id"), F.when(k % 4 == 0, "spatial").when(k % 4 == 1, "single_cell").when(k % 4 == 2, "bulk").alias("dataset_type"), F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("").alias("section_id"),
        F.when(k % 7 == 0, " ").when(k % 7 > 3, F.col("p_type")).alias("species"), F.when(k % 5 == 0, F.sha2("p_name", 256)).when(k % 5 == 1, F.upper(F.sha2("p_name", 256))).alias("sha256"),
    )
    return m.select("id", F.array_join(contracts.problems(contracts.dataset_rules(["spatial", "single_cell"])), ";").alias("problems"))


@query("""with s as (select o_orderkey as sample, case when o_orderkey % 23 = 0 then 'x' else o_custkey::varchar end as e, o_orderkey % 19 = 0 as rm, case when o_orderkey % 29 = 0 then 'Z' else o_orderstatus end as st from orders where o_orderkey % 11 <> 0),
a as (select * from s union all select * from s where sample % 17 = 0), g as (select sample, count(*) as n, bool_or(rm) as rm, min(e) as e, min(st) as st from a group by 1),
r as (select o_orderkey as sample, e, case when n is null then 'unmatched' when n > 1 then 'repeated' when st is distinct from o_orderstatus then 'field_differs' when rm then 'removed' when not regexp_matches(e, '^[0-9]+$') then 'bad_embryo' end as problem from orders left join g on sample = o_orderkey)
select sample, case when problem is null then 'embryo_' || e end as embryo_id, problem from r""")
def identity_sidecar(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("stage"), "o_custkey")
    s = o.where("sample % 11 <> 0").select("sample", F.when(F.col("sample") % 23 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("embryo_id"), (F.col("sample") % 19 == 0).alias("removed"), F.when(F.col("sample") % 29 == 0, "Z").otherwise(F.col("stage")).alias("stage"))
    return contracts.sidecar_findings(o, s.union(s.where("sample % 17 = 0")), ["stage"])


@query("select o_custkey as embryo, count(distinct o_orderstatus) as stage, count(distinct o_orderpriority) as sex from orders group by 1 having count(distinct o_orderstatus) > 1 or count(distinct o_orderpriority) > 1")
def inconsistent_embryos(spark, d):
    return contracts.inconsistent(read(spark, d, "orders").select(F.col("o_custkey").alias("embryo"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("sex")), "embryo", ["stage", "sex"])


@query("""with p as (select l_returnflag as section, case when l_quantity > 49 then 'nan'::double when l_quantity > 48 then null else l_quantity end as x, l_tax as y, case when l_linenumber > 3 then l_quantity end as a, case when l_linenumber > 3 then l_tax + case when l_discount > 0.09 then 1 else 0 end end as b from lineitem)
select section, count(*) as n, count(*) filter (x is null or not isfinite(x) or y is null or not isfinite(y)) as nonfinite, count(*) filter (coalesce(x <> a, a is not null) or coalesce(y <> b, b is not null)) as disagree from p group by 1""")
def coordinate_findings(spark, d):
    l = read(spark, d, "lineitem")
    late = F.col("l_linenumber") > 3
    x = F.when(F.col("l_quantity") > 49, float("nan")).when(F.col("l_quantity") > 48, None).otherwise(F.col("l_quantity"))
    p = l.select(F.col("l_returnflag").alias("section"), x.alias("x"), F.col("l_tax").alias("y"), F.when(late, F.col("l_quantity")).alias("old_x"), F.when(late, F.col("l_tax") + F.when(F.col("l_discount") > 0.09, 1).otherwise(0)).alias("old_y"))
    return contracts.coordinate_findings(p, "section")


@query("""select p_brand as statistic, 'ENSG' || p_size as canonical, count(*) as n from part group by 1, 2 having count(*) > 1""")
def canonical_repeats(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("statistic"), F.concat(F.lit("ENSG"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("gene"))
    return contracts.canonical_repeats(p, ["statistic"], "gene", identifiers.strip_version(F.col("gene")))


@query(f"""with {OBS_SQL}, q as (select r_name as species from region union all select 'LEMURIA'), t as (select species, count(*) filter (phase <> 'BUILDING' and species <> 'ASIA') as n, count(*) filter (cell_id % 3 = 0 and species <> 'AFRICA') as draws from obs group by 1),
g as (select species, count(distinct l_partkey) filter (l_partkey % 5 = 0 and species <> 'EUROPE') as genes, coalesce(bool_or(l_quantity > 0 and species <> 'AMERICA') filter (l_partkey % 5 = 0 and species <> 'EUROPE'), false) as pos from lineitem join obs on cell_id = l_orderkey group by 1),
r as (select species, coalesce(n, 0) as rows, coalesce(genes, 0) as genes, coalesce(pos, false) as pos, coalesce(draws, 0) as draws from q left join t using (species) left join g using (species)),
w as (select species, rows, genes, array_to_string(list_filter([case when rows = 0 then 'no_post_qc_training_observations' end, case when genes = 0 then 'no_prepared_genes_in_checkpoint_vocabulary' end, case when genes > 0 and not pos then 'no_positive_vocabulary_mapped_expression' end, case when draws = 0 then 'no_projected_sampler_exposure' end], lambda x: x is not null), ';') as reasons from r)
select species, rows, genes, case when reasons = '' then 'prepared_ready_training_unverified' else 'blocked' end as status, reasons from w""")
def species_readiness(spark, d):
    o = obs(spark, d).select("cell_id", "species", "phase")
    required = read(spark, d, "region").select(F.col("r_name").alias("species")).union(spark.createDataFrame([("LEMURIA",)], "species string"))
    t = o.groupBy("species").agg(F.count_if((F.col("phase") != "BUILDING") & (F.col("species") != "ASIA")).alias("n"))
    draws = o.groupBy("species").agg(F.count_if((F.col("cell_id") % 3 == 0) & (F.col("species") != "AFRICA")).alias("draws"))
    l = read(spark, d, "lineitem").where("l_partkey % 5 = 0").select(F.col("l_orderkey").alias("cell_id"), "l_partkey", "l_quantity").join(o, "cell_id").where("species <> 'EUROPE'")
    mapped = l.groupBy("species").agg(F.count_distinct("l_partkey").alias("genes"), F.max((F.col("l_quantity") > 0) & (F.col("species") != "AMERICA")).alias("positive"))
    return contracts.readiness(required, t, mapped, draws)


@query("""with a as (select l_partkey as gene, sum(l_quantity) as v from lineitem where l_partkey % 13 <> 0 group by 1), b as (select l_partkey as gene, sum(l_quantity) + case when l_partkey % 10 = 0 then 0.5 else 0 end as v from lineitem where l_partkey % 17 <> 0 group by 1)
select coalesce(a.gene, b.gene) as gene, case when a.gene is null then 'not_published' when b.gene is null then 'not_recomputed' else 'differs' end as problem from a full join b on a.gene = b.gene where a.gene is null or b.gene is null or abs(a.v - b.v) > 1e-12 * greatest(1, abs(a.v), abs(b.v))""")
def published_differences(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("v"))
    again = s.where("gene % 17 <> 0").withColumn("v", F.col("v") + F.when(F.col("gene") % 10 == 0, 0.5).otherwise(0.0))
    return contracts.published_differences(s.where("gene % 13 <> 0"), again, ["gene"], ["v"])


@query("""select supp, flag, case when v > 0 then 'first' else 'second' end as side, abs(v) as times from (select supp, flag, sum(v)::bigint as v from (select l_suppkey as supp, l_returnflag as flag, 1 as v from lineitem where l_linenumber <= 3 union all select l_suppkey, case when l_discount > 0.09 then 'Z' else l_returnflag end, -1 from lineitem where l_linenumber <= 3) group by 1, 2) where v <> 0""")
def replay_differences(spark, d):
    l = read(spark, d, "lineitem").where("l_linenumber <= 3")
    first = l.select(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"))
    return contracts.replay_differences(first, l.select(F.col("l_suppkey").alias("supp"), F.when(F.col("l_discount") > 0.09, "Z").otherwise(F.col("l_returnflag")).alias("flag")))


@query("""with s as (select l_suppkey as supp, l_partkey as gene, sum(l_quantity) as score from lineitem group by 1, 2), b as (select supp, gene from (select *, row_number() over (partition by supp order by score desc, gene) as r from s) where r <= 10),
p as (select supp, gene from (select *, rank() over (partition by supp order by score desc) as r from s) where r <= 10)
select supp, count(p.gene) as listed, count(*) filter (p.gene is not null and b.gene is not null) as found, count(*) = count(*) filter (p.gene is not null and b.gene is not null) as same from p full join b using (supp, gene) group by 1""")
def top_origin(spark, d):
    from cellweave.operators import ranking

    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("score"))
    return contracts.top_origin(ranking.top_k(s, ["supp"], "score", "gene", 10, True), s, ["supp"], "gene", "score", 10)


@query("""with f as (select p_size as file, count(*) as n from part group by 1), s as (select *, sum(n) over (order by file) - n as start from f), i as (select o_orderkey as index from orders)
select index, file, (index - start)::bigint as row from i left join s on index >= start and index < start + n""")
def global_row_offsets(spark, d):
    files = read(spark, d, "part").groupBy(F.col("p_size").alias("file")).agg(F.count("*").alias("n"))
    return contracts.file_rows(read(spark, d, "orders").select(F.col("o_orderkey").alias("index")), files)


@query("select p_partkey as id, replace(p_type || '*' || p_brand || '*', '*', '<unk>') as sequence from part")
def clean_sequences(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), contracts.clean_sequence(F.concat("p_type", F.lit("*"), "p_brand", F.lit("*"))).alias("sequence"))


@query("""select p_brand as species, t as token, case t when 'a' then p_partkey else p_size end as position from part, (select unnest(['a', 'b']) as t)""")
def vocabulary_documents(spark, d):
    text = F.concat(F.lit('{"a": '), F.col("p_partkey").cast("string"), F.lit(', "b": '), F.col("p_size").cast("string"), F.lit("}"))
    return read(spark, d, "part").select(F.col("p_brand").alias("species"), F.explode(contracts.vocabulary(text)).alias("token", "position"))
