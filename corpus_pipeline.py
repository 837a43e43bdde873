"""From documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and reads it back for the next.
A stage's own tables are freed when the next stage begins, as its result is written by then.

Quality and packing cannot be said in SQL (fitted model, tokenizer), so ``ORACLE_SQL`` is None; the tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import line_dedup, mixing, ngram_join, packing, quality
from cellweave.llm.queries import tokenizer_path
from cellweave.storage import Scratch

ORACLE_SQL = None
_LAST: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    while _LAST:
        _LAST.pop().close()
    _LAST.append(Scratch(spark, name))
    return _LAST[-1]


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _scratch(spark, "quality")
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stay in another place go; a document that loses its last line goes with them."""
    done = line_dedup.line_dedup(docs, _scratch(spark, "lines"))
    left = F.coalesce(F.size("line_dedup.dropped") < F.col("line_dedup.n_lines"), F.lit(True)) | (F.col("line_dedup.n_lines") == 0)
    return _sized(done.where(left).select(*docs.columns))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_per_group(docs, _scratch(spark, "join"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it; a last, partial copy is its first words."""
    return _sized(mixing.apply_mix(docs, _scratch(spark, "mix")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, _scratch(spark, "pack"), tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", join_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    between = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        written = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return written
        old, docs = docs, between.write(written, name.replace(" ", "-"))
        between.drop(old)
    return docs
