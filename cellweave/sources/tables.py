"""The cell-by-gene model over relational tables: cells, their metadata, and counts in long form.

A cell is an order, its embryo the customer, the species the customer's region, the phase the market segment; genes are
parts and counts are quantities.  Readers name only the columns they need, so scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, embryo_id, species, phase, cell_type, assay``."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("embryo_id"), F.col("o_orderpriority").alias("cell_type"), F.col("o_orderstatus").alias("assay")
    )
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("embryo_id"), F.col("c_mktsegment").alias("phase"), F.col("c_nationkey").alias("n_nationkey"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("species"))
    # nation and region are dimension tables of at most a few hundred rows; Spark broadcasts them by their size
    return orders.join(customer, "embryo_id").join(nation, "n_nationkey").join(region, "r_regionkey").select("cell_id", "embryo_id", "species", "phase", "cell_type", "assay")


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, gene_id, pos, count``: the long count matrix, ``pos`` the order of genes in a cell."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_quantity").alias("count")
    )


#: The same views for the oracle.
OBS_SQL = """obs as (select o_orderkey as cell_id, o_custkey as embryo_id, r_name as species, c_mktsegment as phase,
 o_orderpriority as cell_type, o_orderstatus as assay from orders join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
EXPR_SQL = "expr as (select l_orderkey as cell_id, l_partkey as gene_id, cast(l_linenumber as bigint) as pos, l_quantity as count from lineitem)"
