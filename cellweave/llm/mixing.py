"""Mixing sources to target weights by Sainte-Lague apportionment.

Native: DataFrame expressions only.  The size of a document is its number of words.  Sources get targets
by weight, none above ``most`` times its size; what exceeds that is shared out again by weight.  The mix is made of
equal blocks of ``block`` words: blocks go to the sources, and within a source to its shards, by the highest
quotients target / (2k - 1), so each shard has an integer quota.  A shard's documents stand in a seeded order;
its blocks are cut from that sequence, every block is taken the same number of times and the first
blocks in the seeded order once more.

A shard holds about ``shard_docs`` documents of one source, whatever the source's share of the table, so
no window of documents grows with the data.  Highest quotients are only listed near the boundary, about two a party:
for n parties and S seats, rounding each share of S + n / 2 seats gives at least S in all, so it holds the S highest
quotients, and rounding each share of S - n / 2 seats gives at most S, so all of those are won.

Nulls: a null text has size 0; documents of a null source are one source, last in order.  A source of
size 0 has target 0.  Repeated rows are documents of their own (ties in the seeded order are
broken by doc_id and text hash; equal rows share what falls to them).  An empty table gives no rows.
Extra columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
SHARD_DOCS = 1000
SEED = 20_260
#: White space between words: space and the characters 0x09 to 0x0D.
SPACE = "\\x20\\x09-\\x0D"


def size_of(text: str = "text") -> Column:
    """The number of words of a text: the places where a word starts."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^{SPACE}]+')".replace("\\", "\\\\")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, n_docs)`` -> the same with ``target``; sources by code point, null last, weigh ``weights`` in turn.

    With sources in order of cap / weight, the capped ones are a prefix; the level of the rest follows
    from running sums, which is the fixed point of sharing the excess out again and again.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    ranked = weighed.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ranked = ranked.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.col("level"))).over(whole)
    first_free = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)
    told = ranked.withColumn("at", F.coalesce(first_free["level"], level))
    return told.select("source", "source_size", "n_docs", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each party of a group by the highest quotients votes / (2k - 1); ties go by ``key``.

    Between the two divisors a group of n parties lists 2n + 2 quotients at most (one seat more on either side is for rounding).
    """
    whole = Window.partitionBy(*group)
    asked = parties.withColumn("__n", F.count("*").over(whole)).withColumn("__votes", F.sum(votes).over(whole))
    slack = F.col("__n") / 2 + 1
    rounded = lambda of: F.when(F.col("__votes") > 0, F.floor(of * F.col(votes) / F.col("__votes") + 0.5)).otherwise(0).cast("long")
    asked = asked.withColumn("__base", rounded(F.greatest(F.col(seats) - slack, F.lit(0.0)))).withColumn("__high", rounded(F.col(seats) + slack))
    asked = asked.withColumn("__left", F.col(seats) - F.sum("__base").over(whole))
    tried = asked.where((F.col("__high") > F.col("__base")) & (F.col("__left") > 0)).select(*group, *key, "__left", F.explode(F.sequence(F.col("__base") + 1, F.col("__high"))).alias("__k"), votes)
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("__k") - 1)), *[F.col(k).asc_nulls_last() for k in key], "__k")
    won = tried.withColumn("__r", F.row_number().over(order)).where("__r <= __left").groupBy(*group, *key).agg(F.count("*").alias("__won"))
    names = list(dict.fromkeys([*group, *key]))
    other = won.select(*[F.col(c).alias(f"__o_{c}") for c in names], "__won")
    same = F.expr(" and ".join(f"`{c}` <=> `__o_{c}`" for c in names))
    joined = asked.join(other, same, "left").withColumn("quota", (F.col("__base") + F.coalesce("__won", F.lit(0))).cast("long"))
    return joined.select(*parties.columns, "quota")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """One row a document: ``doc_id, h, source, size, source_size, target, taken``; ``h`` is the text's hash.

    ``taken`` is the number of words the mix takes, repeats counted: ``taken div size`` whole copies and
    the first ``taken mod size`` words once more.
    """
    sized = scratch.write(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), size_of().alias("size")), "sizes")
    by_source = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most), "targets")
    placed = sized.join(by_source.withColumnRenamed("source", "__s"), F.expr("source <=> __s")).drop("__s")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n_docs") / shard_docs)).cast("int")
    placed = placed.withColumn("shard", shard).withColumn("__o", F.xxhash64(F.lit(seed), "doc_id", "h"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).cast("long")
    top = sainte_lague(by_source.select("source", "target", F.lit(0).alias("g")).withColumn("seats", seats), ["g"], ["source"], "target", "seats")
    top = top.select(F.col("source").alias("__s"), F.col("quota").alias("seats"))
    parties = shards.join(top, F.expr("source <=> __s")).drop("__s")
    quotas = scratch.write(sainte_lague(parties, ["source"], ["shard"], "words", "seats").select("source", "shard", "words", "quota"), "quotas")
    q = quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__h"), "words", "quota")
    placed = placed.join(q, F.expr("source <=> __s and shard = __h")).drop("__s", "__h")
    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("__o", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    blocks = F.greatest(F.ceil(F.col("words") / block), F.lit(1))
    # a shard never takes more than `most` times its words
    placed = placed.withColumn("__q", F.least("quota", F.lit(most) * blocks)).withColumn("__end", end)
    whole, more = F.expr("__q div greatest(ceil(words / %d), 1)" % block), F.expr("__q %% greatest(ceil(words / %d), 1)" % block)
    extra = F.greatest(F.least(F.col("__end"), more * block) - (F.col("__end") - F.col("size")), F.lit(0))
    return placed.select("doc_id", "h", "source", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixed documents, with all their columns: each document as often as it is taken, a last part as its first words."""
    taken = scratch.write(mix(docs, scratch, **options).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "size", "taken").distinct(), "taken")
    taken = taken.withColumnRenamed("size", "__size").withColumnRenamed("taken", "__taken")
    one = taken.groupBy("__d", "__h").agg(F.first("__size").alias("__size"), F.max("__taken").alias("__taken")).where("__taken > 0")
    found = docs.join(one, F.expr("doc_id <=> __d") & (F.xxhash64("text") == F.col("__h")))
    copies = F.expr("transform(sequence(1, cast(ceil(__taken / __size) as int)), i -> cast(least(__size, __taken - (i - 1) * __size) as int))")
    words = F.expr(f"array_join(slice(regexp_extract_all(text, '[^{SPACE}]+[{SPACE}]*', 0), 1, __part), '')".replace("\\", "\\\\"))
    rows = found.withColumn("__part", F.explode(copies))
    return rows.withColumn("text", F.when(F.col("__part") < F.col("__size"), words).otherwise(F.col("text"))).select(*docs.columns)
