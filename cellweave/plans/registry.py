"""All registered queries of the library and their oracle SQL, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import identifiers
from cellweave.operators import aggregates, bins, bootstrap, joins, nulls, quality_control, ranking, sampling, vectors
from cellweave.sources.tables import EXPR_SQL, OBS_SQL, expr, obs, read
from cellweave.streaming import folds

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    """Register a query under its function's name, with its oracle where SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""with {OBS_SQL} select species, phase, count(*) as n_cells, count(distinct embryo_id) as n_embryos,
case when phase not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') then 'overall_summary_only' when count(distinct embryo_id) >= 3 then 'primary' else 'descriptive' end as tier
from obs group by species, phase""")
def coverage_by_phase(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.coverage(obs(spark, d), ["species", "phase"], ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"])


@query(f"with {EXPR_SQL} select cell_id, count(*) filter (count > 0) as n_genes, sum(count) as total_counts from expr group by cell_id")
def cell_metrics(spark, d):
    return quality_control.cell_metrics(expr(spark, d))


_QC = f"""with {EXPR_SQL}, m as (select cell_id, count(*) filter (count > 0) as n_genes, sum(count) as total_counts from expr group by cell_id),
q as (select n_genes < 2 as below_min_genes, total_counts < 30 as below_min_counts, n_genes > 6 as above_max_genes, total_counts > 200 as above_max_counts from m)"""


@query(_QC + """ select count(*) filter (below_min_genes) as below_min_genes, count(*) filter (below_min_counts) as below_min_counts, count(*) filter (above_max_genes) as above_max_genes,
count(*) filter (above_max_counts) as above_max_counts, count(*) filter (not (below_min_genes or below_min_counts or above_max_genes or above_max_counts)) as kept, count(*) as total from q""")
def qc_removal_counts(spark, d):
    return quality_control.removal_counts(quality_control.qc_reasons(quality_control.cell_metrics(expr(spark, d)), 2, 30, 6, 200))


@query(f"""with {EXPR_SQL}, m as (select cell_id, count(*) filter (count > 0) as n_genes, sum(count) as total_counts from expr group by cell_id),
b as (select avg(total_counts) as a, stddev_pop(total_counts) as s from m) select cell_id, n_genes, total_counts from m, b where total_counts > a - 1.5 * s and total_counts < a + 1.5 * s""")
def outlier_filter(spark, d):
    return quality_control.outlier_cells(quality_control.cell_metrics(expr(spark, d)), 1.5)


@query("""select l_returnflag as source, coalesce(bool_and(abs(l_extendedprice - round(l_extendedprice)) < 1e-6) filter (l_extendedprice <> 0), false) as is_raw,
count(*) filter (l_extendedprice <> 0) as n_nonzero from lineitem group by 1""")
def raw_count_check(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("count"))
    return quality_control.raw_counts(rows, ["source"])


_LABEL = "case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then ' NaN ' when o_orderkey % 7 = 2 then 'gastrula' when o_orderkey % 7 = 3 then 'Unknown' else o_orderpriority end"


@query(f"""select label, case when label in ('blastula','gastrula','neurula','organogenesis','fetal') then label when label is null or lower(trim(label)) in ('','nan','none','<na>','unknown') then '<missing>'
else 'unmapped:' || label end as phase, count(*) as n from (select {_LABEL} as label from orders) group by 1, 2""")
def phase_gate(spark, d):
    rows = read(spark, d, "orders").select(F.expr(_LABEL).alias("label"))
    return rows.groupBy("label", quality_control.phase_gate(F.col("label")).alias("phase")).agg(F.count("*").alias("n"))


@query("""select doc, row_number() over (order by kind, n, text) as place from (select distinct l as doc, case when l in ('blastula','gastrula','neurula','organogenesis') then 0 when regexp_extract(l, '^\\s*(\\d+(?:\\.\\d+)?)', 1) <> '' then 1 else 2 end as kind,
case when l = 'blastula' then 1.0 when l = 'gastrula' then 2.0 when l = 'neurula' then 3.0 when l = 'organogenesis' then 4.0 else coalesce(try_cast(regexp_extract(l, '^\\s*(\\d+(?:\\.\\d+)?)', 1) as double), 0) end as n, l as text
from (select case when o_orderkey % 5 = 0 then 'gastrula' when o_orderkey % 5 = 1 then cast(o_orderkey % 30 as varchar) || 'hpf' when o_orderkey % 5 = 2 then 'fetal' else cast(o_orderkey % 11 as varchar) || '.5 d' end as l from orders))""")
def stage_order(spark, d):
    label = "case when o_orderkey % 5 = 0 then 'gastrula' when o_orderkey % 5 = 1 then concat(o_orderkey % 30, 'hpf') when o_orderkey % 5 = 2 then 'fetal' else concat(o_orderkey % 11, '.5 d') end"
    labels = read(spark, d, "orders").select(F.expr(label).alias("doc")).distinct()  # a stage vocabulary is small
    from pyspark.sql import Window

    return labels.select("doc", F.row_number().over(Window.orderBy(quality_control.stage_key(F.col("doc")))).cast("long").alias("place"))


@query("""select p_partkey as id, regexp_replace(g, '^(ENS[A-Z]*\\d+|FBgn\\d+|WBGene\\d+)\\.\\d+$', '\\1') as versionless, split_part(g, '.', 1) as first_part, regexp_replace(u, '^LOC(\\d+)$', 'GeneID_\\1') as urchin,
regexp_replace(regexp_replace(b, '^run_\\d+_', ''), '-\\d+$', '') as barcode from (select p_partkey, case when p_partkey % 2 = 0 then 'ENSG' || p_partkey || '.' || p_size else '2L' || p_partkey || '.1' end as g,
case when p_partkey % 3 = 0 then 'LOC' || p_partkey else 'x' || p_partkey end as u, case when p_partkey % 2 = 0 then 'run_' || p_size || '_AC' || p_partkey || '-1' else 'AC' || p_partkey end as b from part)""")
def identifiers_normalised(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    even = F.col("p_partkey") % 2 == 0
    g = F.when(even, F.concat(F.lit("ENSG"), k, F.lit("."), s)).otherwise(F.concat(F.lit("2L"), k, F.lit(".1")))
    u = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("LOC"), k)).otherwise(F.concat(F.lit("x"), k))
    b = F.when(even, F.concat(F.lit("run_"), s, F.lit("_AC"), k, F.lit("-1"))).otherwise(F.concat(F.lit("AC"), k))
    return p.select(
        F.col("p_partkey").alias("id"), identifiers.strip_version(g).alias("versionless"), identifiers.strip_after_dot(g).alias("first_part"), identifiers.canonical_urchin(u).alias("urchin"), identifiers.barcode(b).alias("barcode")
    )


@query("select id, packed // 4294967296 as x, packed % 4294967296 as y from (select o_orderkey as id, o_orderkey * 4294967296 + o_custkey as packed from orders)")
def packed_coordinates(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * F.lit(1 << 32) + F.col("o_custkey")).alias("packed"))
    return o.select("id", identifiers.packed_xy(F.col("packed")).alias("p")).select("id", "p.x", "p.y")


@query(f"""with {EXPR_SQL} select cell_id, gene_id, sum(count) as count, min(pos) as pos, count(*) as n_collapsed from expr group by 1, 2""")
def collapse_duplicate_genes(spark, d):
    return aggregates.collapse_duplicates(expr(spark, d))


@query(f"""with {EXPR_SQL} select cell_id, gene_id, pos, count from (select *, row_number() over (partition by cell_id, gene_id order by pos, count) as r from expr) where r = 1""")
def drop_duplicate_genes(spark, d):
    return aggregates.drop_later_duplicates(expr(spark, d)).select("cell_id", "gene_id", "pos", "count")


@query("""with v as (select p_partkey as token from part where p_size <= 25), m as (select p_partkey as gene_id, p_partkey + 1 as target from part where p_partkey % 2 = 0)
select p_partkey as gene_id, case when v.token is not null then p_partkey when v2.token is not null then target end as mapped from part left join v on v.token = p_partkey
left join m on m.gene_id = p_partkey left join v as v2 on v2.token = m.target""")
def gene_mapping(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    vocab = p.where("p_size <= 25").select(F.col("p_partkey").alias("token"))
    mapping = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("gene_id"), (F.col("p_partkey") + 1).alias("target"))
    return joins.map_genes(p.select(F.col("p_partkey").alias("gene_id")), mapping, vocab)


@query(f"""with {EXPR_SQL} select cell_id, sum(x.count) as count from expr x semi join (select p_partkey from part where p_size <= 25) v on v.p_partkey = x.gene_id group by 1""")
def vocabulary_filter(spark, d):
    vocab = read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("gene_id"))
    return expr(spark, d).join(vocab, "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("count").alias("count"))


_STATS = f"""{OBS_SQL}, {EXPR_SQL}, n as (select species, embryo_id, count(*) as n_cells from obs group by 1, 2),
x as (select cell_id, gene_id, count, ln(1 + count / sum(count) over (partition by cell_id) * 10000) as x from expr),
s as (select species, embryo_id, gene_id, sum(x) as log_sum, count(*) filter (count > 0) as detected from x join obs using (cell_id) group by 1, 2, 3)"""


@query(f"with {_STATS} select species, embryo_id, gene_id, round(log_sum, 6) as log_sum, detected, n_cells from s join n using (species, embryo_id)")
def embryo_statistics(spark, d):
    s = aggregates.embryo_statistics(expr(spark, d), obs(spark, d), ["species"])
    return s.select("species", "embryo_id", "gene_id", F.round("log_sum", 6).alias("log_sum"), "detected", "n_cells")


@query(f"""with {_STATS}, c as (select species, count(*) as n from obs group by 1), g as (select species, gene_id, sum(log_sum) as a, sum(detected) as b from s group by 1, 2)
select species, gene_id, round(a / n, 6) as mean_log1p, round(1 - b / n, 6) as dropout from g join c using (species)""")
def pooled_gene_metrics(spark, d):
    o = obs(spark, d)
    m = aggregates.pooled_metrics(aggregates.embryo_statistics(expr(spark, d), o, ["species"]), o, ["species"])
    return m.select("species", "gene_id", F.round("mean_log1p", 6).alias("mean_log1p"), F.round("dropout", 6).alias("dropout"))


def _scores(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("score"))
    return l.join(obs(spark, d), "cell_id")


@query(f"""with {OBS_SQL}, e as (select species, phase, embryo_id, avg(l_quantity) as m, count(*) as n from lineitem join obs on cell_id = l_orderkey where l_discount > 0.02 group by 1, 2, 3)
select species, phase, round(avg(m), 6) as mean, cast(sum(n) as bigint) as n_cells, count(*) as n_embryos from e group by 1, 2""")
def balanced_mean(spark, d):
    m = aggregates.balanced_mean(_scores(spark, d), ["species", "phase"], "score")
    return m.select("species", "phase", F.round("mean", 6).alias("mean"), "n_cells", "n_embryos")


@query(f"with {OBS_SQL} select embryo_id, count(distinct cell_type) as n_values from obs group by 1 having count(distinct cell_type) > 1")
def dependency_violations(spark, d):
    return aggregates.dependency_violations(obs(spark, d), "embryo_id", "cell_type")


@query("""select l_returnflag, l_linestatus, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) as share from lineitem group by 1, 2""")
def confusion_matrix(spark, d):
    c = aggregates.confusion(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return c.select("l_returnflag", "l_linestatus", "n", F.round("share", 6).alias("share"))


@query("""with p as (select l_partkey % 5 as t, (l_partkey + case when l_linenumber > 4 then 1 else 0 end) % 5 as p from lineitem), c as (select t as c from p union select p from p),
f as (select c, (select count(*) from p where t = c) as a, (select count(*) from p where p.p = c) as b, (select count(*) from p where t = c and p.p = c) as h from c) select round(avg(2.0 * h / (a + b)), 6) as macro_f1, count(*) as n_classes from f""")
def macro_f1(spark, d):
    p = read(spark, d, "lineitem").select((F.col("l_partkey") % 5).alias("t"), ((F.col("l_partkey") + (F.col("l_linenumber") > 4).cast("int")) % 5).alias("p"))
    return aggregates.macro_f1(p, "t", "p").select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


@query("""select l_returnflag, round(avg(d), 6) as mean, round(median(d), 6) as median, count(*) filter (d > 0) as n_pos, count(*) filter (d < 0) as n_neg, count(*) filter (d = 0) as n_zero
from (select l_returnflag, l_quantity - 25 as d from lineitem) group by 1""")
def paired_differences(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), F.lit(25.0).alias("b"))
    p = aggregates.paired_differences(rows, ["l_returnflag"], "a", "b")
    return p.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n_pos", "n_neg", "n_zero")


_PARTS = "select p_partkey as id, p_brand as g, p_size as v, p_retailprice as w from part"


def _parts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.col("p_size").alias("v"), F.col("p_retailprice").alias("w"))


@query(f"""select id, rank() over (partition by g order by v) + (count(*) over (partition by g, v) - 1) / 2.0 as avg_rank,
cast(least(9, floor(10 * (2 * (rank() over (partition by g order by v) - 1) + count(*) over (partition by g, v)) / (2 * count(*) over (partition by g)))) as bigint) as decile from ({_PARTS})""")
def tie_ranks_and_deciles(spark, d):
    return _parts(spark, d).select("id", ranking.average_rank("v", ["g"]).cast("double").alias("avg_rank"), ranking.midrank_decile("v", ["g"]).alias("decile"))


@query(f"""select id, g, 'ties' as rule, place from (select id, g, rank() over (partition by g order by v desc) as place from ({_PARTS})) where place <= 5
union all select id, g, 'key', place from (select id, g, row_number() over (partition by g order by v desc, id) as place from ({_PARTS})) where place <= 5""")
def top_k_tie_rules(spark, d):
    p = _parts(spark, d)
    return ranking.top_k(p, ["g"], "v", "id", 5, True).select("id", "g", F.lit("ties").alias("rule"), "place").union(ranking.top_k(p, ["g"], "v", "id", 5, False).select("id", "g", F.lit("key"), "place"))


@query(f"""with r as (select id, g, w / 3000 as p, row_number() over (partition by g order by w / 3000, id) as r, count(*) over (partition by g) as n from ({_PARTS}))
select id, round(least(1, min(p * n / r) over (partition by g order by r desc rows unbounded preceding)), 6) as q from r""")
def benjamini_hochberg(spark, d):
    return ranking.benjamini_hochberg(_parts(spark, d).withColumn("p", F.col("w") / 3000), ["g"], "p", "id").select("id", F.round("q", 6).alias("q"))


@query(f"""with r as (select g, rank() over (partition by g order by v) + (count(*) over (partition by g, v) - 1) / 2.0 as a, rank() over (partition by g order by w) + (count(*) over (partition by g, w) - 1) / 2.0 as b from ({_PARTS}))
select g, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) as rho, count(*) as n, cast(null as varchar) as reason from r group by g""")
def spearman_by_group(spark, d):
    return ranking.spearman(_parts(spark, d), ["g"], "v", "w").select("g", F.round("rho", 6).alias("rho"), "n", "reason")


@query("select l_returnflag, quantile_disc(l_extendedprice, 0.95) as q95, (1 + count(*) filter (l_quantity >= 45)) / (count(*) + 1) as p_upper from lineitem group by 1")
def quantile_and_empirical_p(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.95) within group (order by l_extendedprice)").alias("q95"), ((1 + F.count_if(F.col("l_quantity") >= 45)) / (F.count("*") + 1)).alias("p_upper"))


@query(f"with {EXPR_SQL} select cell_id, pos, gene_id, cast(coalesce(sum(cast(count as bigint)) over (partition by cell_id order by pos, gene_id, count rows between unbounded preceding and 1 preceding), 0) as bigint) as start from expr")
def prefix_offsets(spark, d):
    e = expr(spark, d).withColumn("size", F.col("count").cast("long"))
    return ranking.prefix_offsets(e, ["cell_id"], "size", ["pos", "gene_id", "count"]).select("cell_id", "pos", "gene_id", "start")


@query("""with u as (select c_mktsegment || c_nationkey as species, c_custkey as embryo_id, c_custkey % 11 = 0 as train_only from customer), f as (select * from u where not train_only),
r as (select *, row_number() over (partition by species order by sha256('0' || chr(0) || species || chr(0) || embryo_id)) as r, count(*) over (partition by species) as n from f),
s as (select *, greatest(1, cast(round_even(n * 0.2, 0) as int)) as v, greatest(1, cast(round_even(n * 0.1, 0) as int)) as h from r)
select species, embryo_id, case when n < 3 then 'train' when r <= v then 'validation' when r <= v + h then 'holdout' else 'train' end as split, case when n < 3 then 'insufficient_embryos' else 'assigned' end as reason from s
union all select species, embryo_id, 'train', 'train_only' from u where train_only""")
def assign_splits(spark, d):
    c = read(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("species"), F.col("c_custkey").alias("embryo_id"), (F.col("c_custkey") % 11 == 0).alias("train_only"))
    return sampling.assign_splits(c)


@query("""with g as (select c_mktsegment as g, c_nationkey as k, count(*) as size from customer group by 1, 2), n as (select count(*) as n from g),
q as (select g, k, unnest(range(2, greatest(3, least(size, 400) + 1))) as j, size from g), r as (select g, k, row_number() over (order by size / j desc, g, k, j) as r from q where j <= size),
e as (select g, k, count(*) as more from r, n where r.r <= 400 - n.n group by 1, 2) select g.g, g.k, g.size, 1 + coalesce(more, 0) as slots from g left join e on g.g = e.g and g.k = e.k""")
def dhondt_cohort(spark, d):
    g = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k")).agg(F.count("*").alias("size"))
    return sampling.dhondt_cohort(g, "size", ["g", "k"], 400)


@query("""select g, id, place from (select c_mktsegment as g, c_custkey as id, row_number() over (partition by c_mktsegment order by sha256('3' || chr(0) || c_mktsegment || chr(0) || c_custkey)) as place from customer) where place <= 20""")
def hash_selection(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("id"))
    return sampling.hash_selection(c, ["g"], "id", 20, 3)


@query("""with r as (select c_mktsegment as g, c_nationkey as k, c_custkey as id, sha256('0' || chr(0) || c_custkey) as h from customer), x as (select *, row_number() over (partition by g, k order by h) as r from r)
select id, g, k from x order by case when r > greatest(1, 300 // (select count(*) from (select distinct g, k from r))) then 1 else 0 end, h limit 300""")
def stratified_cap(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k"))
    return sampling.stratified_cap(c, ["g", "k"], "id", 300)


@query("""with l as (select o_orderkey as id, o_custkey % 50 as seq, cast(epoch(o_orderdate) as bigint) // 86400 as s, cast(epoch(o_orderdate) as bigint) // 86400 + o_orderkey % 60 as e from orders where o_orderkey % 3 = 0),
r as (select o_orderkey as hit, o_custkey % 50 as seq, cast(epoch(o_orderdate) as bigint) // 86400 as s2, cast(epoch(o_orderdate) as bigint) // 86400 + o_orderkey % 45 as e2 from orders where o_orderkey % 3 <> 0),
m as (select id, hit, least(e, e2) - greatest(s, s2) + 1 as overlap, e - s + 1 as z, e2 - s2 + 1 as z2 from l join r on l.seq = r.seq and s <= e2 and s2 <= e), b as (select id, max(overlap) as overlap from m group by 1),
t as (select m.id, m.overlap, count(*) as n, min(hit) as hit, min(z) as z, arg_min(z2, hit) as z2 from m join b on m.id = b.id and m.overlap = b.overlap group by 1, 2)
select id, case when n = 1 then hit end as hit, overlap, n > 1 as ambiguous, round(least(overlap / z, overlap / z2), 6) as reciprocal from t""")
def interval_overlap(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("seq"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("start"))
    left = o.where("id % 3 = 0").withColumn("end", F.col("start") + F.col("id") % 60)
    right = o.where("id % 3 <> 0").withColumn("end", F.col("start") + F.col("id") % 45)
    return joins.interval_overlap(left, right, 64).withColumn("reciprocal", F.round("reciprocal", 6))


_PAIRS = "select distinct l_partkey * 100 + l_orderkey % 100 as a, l_suppkey * 1000 + l_orderkey % 1000 as b from lineitem"


@query(f"with p as ({_PAIRS}) select a, b from p where a in (select a from p group by a having count(*) = 1) and b in (select b from p group by b having count(*) = 1)")
def strict_bijection(spark, d):
    return joins.strict_bijection(_pairs(spark, d), "a", "b")


def _pairs(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_orderkey") % 100).alias("a"), (F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 1000).alias("b"))


@query(f"""with p as ({_PAIRS}) select coalesce(case when count_a > 1 then 'source_to_many' when count_b > 1 then 'many_to_target' end, 'one_to_one') as reason, count(*) as n
from (select count(*) over (partition by a) as count_a, count(*) over (partition by b) as count_b from p) group by 1""")
def conversion_ambiguity(spark, d):
    return joins.ambiguity(_pairs(spark, d), "a", "b").groupBy(F.coalesce("reason", F.lit("one_to_one")).alias("reason")).agg(F.count("*").alias("n"))


@query("""with l as (select o_orderkey as a, o_custkey * 16 + o_orderkey % 16 as via from orders), s as (select c_custkey * 16 + unnest(range(0, 16)) as via from customer),
r as (select via, via * 10 as b from s union all select via, via * 10 + 1 from s where via % 5 = 0)
select distinct a, b from (select via, min(a) as a from l group by 1 having count(*) = 1) x join (select via, min(b) as b from r group by 1 having count(*) = 1) y using (via)""")
def bridge_composition(spark, d):
    left = read(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") * 16 + F.col("o_orderkey") % 16).alias("via"))
    s = read(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot")).select((F.col("c_custkey") * 16 + F.col("slot")).alias("via"))
    right = s.select("via", (F.col("via") * 10).alias("b")).union(s.where("via % 5 = 0").select("via", (F.col("via") * 10 + 1).alias("b")))
    return joins.compose_bridge(left, right)


@query("""with k as (select distinct l_shipmode as g, l_partkey as k from (select l_suppkey % 6 as l_shipmode, l_partkey from lineitem)) select a.g as group_a, b.g as group_b, count(*) as n_shared from k a join k b on a.k = b.k and a.g < b.g group by 1, 2""")
def barcode_overlap(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 6).alias("g"), F.col("l_partkey").alias("k"))
    return joins.shared_keys(rows, "g", "k")


@query("""with f as (select l_suppkey as cell_id, s_nationkey as embryo_id, p_brand || p_type as gene_id, avg(case when l_discount > 0.01 then l_quantity end) as score from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
b as (select distinct gene_id, substr(gene_id, 1, 7) as bin from f), s as (select f.*, bin from f join b using (gene_id) where score is not null),
o as (select gene_id as focal, avg(m) as observed, cast(sum(n) as bigint) as n_cells, count(*) as n_embryos from (select gene_id, embryo_id, avg(score) as m, count(*) as n from s group by 1, 2) group by 1),
p as (select x.gene_id as focal, y.gene_id as peer, x.embryo_id, avg(y.score) as m, count(*) as n from s x join s y on x.cell_id = y.cell_id and x.bin = y.bin and x.gene_id <> y.gene_id group by 1, 2, 3),
q as (select focal, peer, avg(m) as mean, sum(n) as covered from p group by 1, 2), j as (select q.*, covered = n_cells as whole from q join o using (focal)),
n as (select focal, count(*) as candidates, count(*) filter (whole) as matched, avg(mean) filter (whole) as null_mean, stddev_samp(mean) filter (whole) as null_sd from j group by 1)
select focal, round(observed, 6) as observed, n_cells, n_embryos, coalesce(candidates, 0) as candidates, coalesce(matched, 0) as matched, case when coalesce(matched, 0) < 2 then 'fewer_than_two_matched_peers' when coalesce(null_sd, 0) < 1e-12 then 'zero_or_nonfinite_null_variance' end as reason,
case when coalesce(matched, 0) >= 2 and coalesce(null_sd, 0) >= 1e-12 then round((observed - null_mean) / null_sd, 5) end as z from o left join n using (focal)""")
def matched_peer_null(spark, d):
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("score"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", "p_type").alias("gene_id"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("embryo_id"))
    facts = l.join(p, "l_partkey").join(s, "l_suppkey").groupBy(F.col("l_suppkey").alias("cell_id"), "embryo_id", "gene_id").agg(F.avg("score").alias("score"))
    bins_ = facts.select("gene_id", F.substring("gene_id", 1, 7).alias("bin")).distinct()
    z = nulls.matched_peer_z(facts, bins_)
    return z.select("focal", F.round("observed", 6).alias("observed"), "n_cells", "n_embryos", "candidates", "matched", "reason", F.round("z", 5).alias("z"))


@query(None)
def expression_bins(spark, d):
    return bins.expression_bins(pooled_gene_metrics(spark, d), ["species"])


@query(None)
def bootstrap_interval(spark, d):
    s = _scores(spark, d).where("score is not null").groupBy("species", "embryo_id").agg(F.avg("score").alias("m"))
    return bootstrap.interval_of(s, bootstrap.drawn_means(s, ["species"]), ["species"])


@query("""with d as (select a.vec_id as id, b.vec_id as neighbour, list_distance(a.embedding::double[], b.embedding::double[]) as distance from embeddings a, embeddings b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by id order by distance, neighbour) as rank from d) select id, neighbour, rank, round(distance, 5) as distance from r where rank <= 5""")
def exact_knn(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.knn(v, 5).withColumn("distance", F.round("distance", 5))


_KNN = """d as (select a.vec_id as id, b.vec_id as neighbour, list_distance(a.embedding::double[], b.embedding::double[]) as distance from embeddings a, embeddings b where a.vec_id <> b.vec_id),
k as (select id, neighbour from (select id, neighbour, row_number() over (partition by id order by distance, neighbour) as r from d) where r <= 5)"""


@query(f"""with {_KNN}, m as (select id, a.label, avg(case when a.label = b.label then 1.0 else 0.0 end) as p from k join embeddings a on a.vec_id = id join embeddings b on b.vec_id = neighbour group by 1, 2)
select label, round(avg(p), 6) as purity, count(*) as n from m group by 1""")
def neighbour_purity(spark, d):
    e = read(spark, d, "embeddings")
    n = vectors.knn(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5)
    return vectors.purity(n, e.select(F.col("vec_id").alias("id"), "label")).withColumn("purity", F.round("purity", 6))


@query("""with p as (select c_custkey as id, c_nationkey as section, c_acctbal as x, c_acctbal * (c_custkey % 7) as y from customer), b as (select section, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by 1)
select id, section, coalesce(least(7, greatest(0, cast(floor((x - x0) / nullif(x1 - x0, 0) * 8) as int))), 0) || '_' || coalesce(least(7, greatest(0, cast(floor((y - y0) / nullif(y1 - y0, 0) * 8) as int))), 0) as token from p join b using (section)""")
def spatial_grid_bins(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("section"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * (F.col("c_custkey") % 7)).alias("y"))
    return vectors.grid_bins(c, "section", 8).select("id", "section", "token")


@query("""with x as (select vec_id as id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), y as (select vec_id as id, generate_subscripts(embedding, 1) as i, unnest(list_reverse(embedding))::double as x from embeddings),
xx as (select id, i, x - avg(x) over (partition by i) as x from x), yy as (select id, i, x - avg(x) over (partition by i) as x from y),
c as (select sum(g * g) as s from (select sum(a.x * b.x) as g from xx a join yy b using (id) group by a.i, b.i)), cx as (select sqrt(sum(g * g)) as s from (select sum(a.x * b.x) as g from xx a join xx b using (id) group by a.i, b.i)),
cy as (select sqrt(sum(g * g)) as s from (select sum(a.x * b.x) as g from yy a join yy b using (id) group by a.i, b.i)) select round(c.s / (cx.s * cy.s), 6) as cka, (select count(*) from embeddings) as n from c, cx, cy""")
def linear_cka(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.linear_cka(v, v.select("id", F.reverse("v").alias("v"))).withColumn("cka", F.round("cka", 6))


@query(f"""with {_KNN}, p as (select vec_id as id, list_sum(embedding::double[]) as value from embeddings), z as (select id, value - (select avg(value) from p) as z from p),
e as (select id, neighbour from k union select neighbour, id from k) select round(((select count(*) from z) * (select sum(a.z * b.z) from e join z a on a.id = e.id join z b on b.id = neighbour)) / ((select count(*) from e) * (select sum(z * z) from z)), 6) as morans_i,
(select count(*) from z) as n, (select count(*) from e) as weight""")
def morans_i(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.morans_i(e.select("id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("value")), vectors.knn(e, 5)).withColumn("morans_i", F.round("morans_i", 6))


@query("""with n as (select max(vec_id) + 1 as n from embeddings), t as (select l_orderkey as cell_id, (l_orderkey * 7 + l_partkey) % n as token from lineitem, n),
x as (select cell_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from t join embeddings on vec_id = token),
m as (select cell_id, i, avg(x) as x from x group by 1, 2) select cell_id, round(sum(x), 4) as pooled_sum, count(*) as dim from m group by 1""")
def pooled_gene_embeddings(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg((F.max("id") + 1).alias("n"))
    t = read(spark, d, "lineitem").crossJoin(n).select(F.col("l_orderkey").alias("cell_id"), ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % F.col("n")).alias("token"))
    p = vectors.mean_pool(t, e, "cell_id", "token")
    return p.select("cell_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("pooled_sum"), F.size("v").cast("long").alias("dim"))


@query("""select 'both' as part, count(*) as n from (select distinct l_partkey from lineitem where l_returnflag = 'A' intersect select distinct l_partkey from lineitem where l_returnflag = 'R')
union all select 'only_a', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R')
union all select 'either', count(distinct l_partkey) from lineitem where l_returnflag in ('A', 'R')""")
def gene_set_algebra(spark, d):
    l = read(spark, d, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    parts = {"both": a.intersect(b), "only_a": a.distinct().join(b, "l_partkey", "left_anti"), "either": a.union(b).distinct()}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, x in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("""with a as (select user_id as run, event_id as step, value as loss, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as best, row_number() over (partition by user_id order by event_id) as r from events),
b as (select *, max(case when best is null or loss < best then r end) over (partition by run order by r rows unbounded preceding) as last from a) select run, min(step) filter (r - last >= 3) as stop from b group by 1""")
def early_stopping(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return folds.early_stops(e, 3)


from cellweave.plans import contracts, findings, surveyed  # noqa: E402, F401  its queries are registered here
