"""Line-oriented scientific formats as DataFrames: GFF, FASTA headers, pair tables, and shards with control rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features with attributes as a map; comments are left out."""
    raw = spark.read.text(path).where("value not like '#%' and value <> ''").select(F.split("value", "\t").alias("c")).where("size(c) = 9")
    return raw.select(
        F.col("c")[0].alias("seqid"), F.col("c")[2].alias("type"), F.col("c")[3].cast("long").alias("start"), F.col("c")[4].cast("long").alias("end"), F.col("c")[6].alias("strand"), F.expr("str_to_map(c[8], ';', '=')").alias("attributes")
    )


def fasta_headers(spark: SparkSession, path: str) -> DataFrame:
    """Accession, gene and description of each FASTA record; sequences are never read into a row."""
    head = spark.read.text(path).where("value like '>%'")
    return head.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("accession"), F.regexp_extract("value", r"gene[:=](\S+)", 1).alias("gene"), F.regexp_extract("value", r"^>\S+\s*(.*)$", 1).alias("description"))


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """A header-less, possibly gzipped, tab-separated table of ortholog pairs."""
    return spark.read.csv(path, sep="\t", schema="species_a string, gene_a string, species_b string, gene_b string", mode="FAILFAST")


def shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines shards whose control rows (``kind`` header and footer) are left out."""
    return spark.read.json(path, schema=f"kind string, {schema}", mode="FAILFAST").where("kind is null or kind = 'row'").drop("kind")


def shard_mismatches(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose footer count differs from their rows: empty where all are whole."""
    rows = spark.read.json(path, schema="kind string, count long").withColumn("file", F.col("_metadata.file_path"))
    told = rows.groupBy("file").agg(F.count_if(F.coalesce(F.col("kind"), F.lit("row")) == "row").alias("n"), F.max(F.when(F.col("kind") == "footer", F.col("count"))).alias("footer"))
    return told.where("footer is null or footer <> n")
