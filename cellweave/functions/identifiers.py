"""Gene, barcode and coordinate identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_after_dot(gene: Column) -> Column:
    """The id up to its first dot."""
    return F.substring_index(gene, ".", 1)


def strip_version(gene: Column) -> Column:
    """The id without a version, for id families that have versions; other dots stay."""
    return F.regexp_replace(gene, r"^(ENS[A-Z]*\d+|FBgn\d+|WBGene\d+)\.\d+$", "$1")


def canonical_urchin(gene: Column) -> Column:
    """``LOC123`` and ``GeneID_123`` are one gene."""
    return F.regexp_replace(gene, r"^LOC(\d+)$", "GeneID_$1")


def barcode(name: Column) -> Column:
    """A barcode without a leading run number and a trailing lane number."""
    return F.regexp_replace(F.regexp_replace(name, r"^run_\d+_", ""), r"-\d+$", "")


def packed_xy(packed: Column) -> Column:
    """The two 32-bit halves of an unsigned 64-bit coordinate, given as a decimal."""
    wide = packed.cast("decimal(20,0)")
    half = F.lit(1 << 32).cast("decimal(20,0)")
    return F.struct(F.floor(wide / half).cast("long").alias("x"), F.pmod(wide, half).cast("long").alias("y"))
