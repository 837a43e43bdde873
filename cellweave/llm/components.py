"""Connected components and component-wise linking, shared by the near-duplicate operators.

All are plain DataFrame plans.  State between rounds lives in written tables (``storage.Scratch``);
the driver only ever sees counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import Scratch

#: Largest broadcast side, in estimated bytes; beyond it the same join shuffles.
SMALL_BYTES = 16 << 20
#: One id in so many is drawn to find hot buckets; a bucket with ``HOT`` drawn members or more is split in parts of about ``PART``.
DRAWN, HOT, PART = 64, 16, 1024
#: Shuffled orders in which the members of open buckets are tested against their neighbours.
SWEEPS = 3
#: A further order is tried while one link is found for so many open memberships.
WORTH = 50


def small(table: DataFrame, width: int) -> DataFrame:
    """The table with a broadcast hint if its rows of about ``width`` bytes are surely few; unchanged otherwise."""
    most = SMALL_BYTES // width
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def narrow(big: DataFrame, ids: DataFrame, on: list[str], width: int = 48) -> DataFrame:
    """Inner join of a large table with few rows: by broadcast while ``ids`` is small, else by shuffle."""
    return big.join(small(ids, width), on)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Distributed union-find: ``edges(a, b)`` -> ``(id, comp)`` with the smallest id of each component.

    Each round hooks every vertex onto the smallest label among its neighbours and then halves the
    label paths (label of the label).  Stars end after two rounds and a path of length L after
    O(log L).  A vertex with very many edges is pre-aggregated map-side by ``min``.
    Self-loops and repeated edges are harmless; null ends are ignored; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = scratch.write(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "adjacency")
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("comp").alias("near"))
        hooked = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        # the label of each vertex may itself hook lower: the offer goes to the old label too
        offers = labels.join(hooked, "id").select("id", "comp", F.least("comp", "near").alias("offer"))
        offers = scratch.write(offers, "offers")
        at_root = offers.groupBy(F.col("comp").alias("id")).agg(F.min("offer").alias("root_offer"))
        own = offers.select("id", "comp", "offer")
        stepped = own.join(at_root.select(F.col("id").alias("comp"), "root_offer"), "comp").select(
            "id", F.col("comp").alias("was"), F.least("offer", "root_offer").alias("comp")
        )
        jump = stepped.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = stepped.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "was")
        new = scratch.write(new, "labels")
        moved = new.where("comp < was").limit(1).count()
        scratch.drop(labels)
        scratch.drop(offers)
        labels = new.drop("was")
        labels._cellweave_path = new._cellweave_path
        if not moved:
            scratch.drop(both)
            return labels


def merged(comp: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(id, comp)`` after more edges ``(a, b)``: only the graph of the components is walked again."""
    ends = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    named = scratch.write(ends.join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNull().alias("alone")), "named")
    of = named.select("id", "comp")
    between = found.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    top = components(between, scratch).toDF("comp", "top")
    every = comp.select("id", "comp").union(named.where("alone").select("id", "comp"))
    return scratch.write(every.join(small(top, 32), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "component")


def share(members: Callable[[DataFrame], DataFrame], rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Bucket memberships -> written ``(key, id, prev, head, parts)`` of the buckets with two ids or more.

    ``members`` makes ``(key, id)`` of ``rows(id, ...)``.  ``prev`` is the next smaller id of the bucket, or of its
    part, and ``head`` the smallest id of the bucket.  Buckets that a sample by hash shows to be hot are dealt out in
    ``parts``, so no window holds one whole; their heads come from an aggregation that is merged map-side.
    """
    drawn = members(rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(DRAWN)) == 0))
    hot = drawn.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    hot = scratch.write(hot.select("key", F.greatest(F.lit(2), F.ceil(F.col("n") * DRAWN / PART)).cast("int").alias("parts")), "hot")
    every, by = members(rows).select("key", "id"), ["key"]
    heads = None
    if hot.limit(1).count():
        heads = scratch.write(every.join(small(hot, 48), "key").groupBy("key").agg(F.first("parts").alias("parts"), F.min("id").alias("top")), "heads")
        # part 0 is a bucket that is not dealt out
        part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int") + 1, F.lit(0))
        every, by = every.join(small(heads, 56).select("key", "parts"), "key", "left").select("key", "id", part.alias("part")), ["key", "part"]
    # most ids are alone in their bucket: they go before anything is sorted, by an aggregation of the rows that are shuffled once for it and for the join
    every = every.repartition(*by)
    met = every.groupBy(*by).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = met.where("low < high or part > 0" if heads is not None else "low < high").select(*by)
    # not a semi join, which would be pushed below the shuffle
    placed = every.join(met.hint("shuffle_hash"), by)
    if heads is not None:
        placed = placed.join(small(heads, 56), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        placed = placed.withColumns({"parts": F.lit(1), "top": F.lit(None).cast("long")})
    by_key = Window.partitionBy(*by).orderBy("id")
    ranked = placed.select("key", "id", "parts", "top", F.lag("id").over(by_key).alias("prev"), F.lead("id").over(by_key).alias("next"), F.first("id").over(by_key).alias("first"))
    kept = ranked.where("prev is not null or next is not null or (parts > 1 and id <> top)")
    return scratch.write(kept.select("key", "id", "prev", F.coalesce("top", "first").alias("head"), "parts"), "shared")


def link(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Components of all verified pairs that share a bucket, without a row for each pair of a bucket.

    ``shared`` comes from ``share``; ``verify`` keeps the pairs ``(a, b)`` that are truly similar; ``large`` takes
    memberships ``(key, id, comp, parts)`` of open buckets and returns verified pairs that unite all their similar members.

    First every member is tested against its bucket's head and its predecessor: two rows a membership.  That is every pair of
    a bucket of up to three.  A bucket is open while it has more members than that and more than one component.  Members
    of open buckets are tested against a neighbour of another component in up to ``SWEEPS`` shuffled orders, which unites most
    groups.  What is still open goes to ``large``.  So every pair of every bucket is tested, or joins one component already.
    Returns written ``(id, comp)`` for ids in a component of two or more.
    """
    pairs = shared.where("prev is not null").select(F.col("prev").alias("a"), F.col("id").alias("b")).union(shared.select(F.col("head").alias("a"), F.col("id").alias("b")))
    comp = components(scratch.write(verify(pairs.where("a <> b").distinct()), "edges"), scratch)
    left, little = shared.select("key", "id", "parts"), False
    for sweep in range(SWEEPS + 1):
        now = left.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "parts")
        still = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.max("parts").alias("most")).where("low < high and (n > 3 or most > 1)").select("key")
        before, left = left, scratch.write(now.join(still, "key", "left_semi"), "open")
        if sweep:
            scratch.drop(before)
        members = left.count()
        if not members:
            return comp
        if sweep == SWEEPS or little:
            break
        order = Window.partitionBy("key", F.pmod(F.xxhash64("id", F.lit(sweep)), F.col("parts"))).orderBy(F.xxhash64("id", F.lit(sweep), F.lit(1)), "id")
        near = left.select("id", "comp", F.lag("id").over(order).alias("prev"), F.lag("comp").over(order).alias("before"))
        across = near.where("comp <> before").select(F.least("id", "prev").alias("a"), F.greatest("id", "prev").alias("b")).distinct()
        found = scratch.write(verify(across), "edges")
        united = found.count()
        if united:
            comp = merged(comp, found, scratch)
        little = united * WORTH < members  # most of what is open is truly apart
        left = left.drop("comp")
    found = scratch.write(large(left), "edges")
    return merged(comp, found, scratch) if found.limit(1).count() else comp


def tiled(members: DataFrame, weight: str, most: int) -> DataFrame:
    """Memberships ``(key, id, comp, parts, ...)`` with ``slab``, a number such that a slab's rows weigh ``most`` at most, or are one row.

    Members stand by component inside each part of a bucket, so most slabs hold one component only; see ``slab_pairs``.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("long")
    order = Window.partitionBy("key", part).orderBy("comp", "id")
    start = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return members.withColumn("slab", part * F.lit(1 << 32) + F.floor(start / most).cast("long"))


def slab_pairs(slabs: DataFrame) -> DataFrame:
    """Written slabs ``(key, slab, low, high)`` -> pairs ``(key, slab, other)`` of slabs that hold more than one component between them.

    A slab is a bounded number of members, so its row number within the bucket grows slowly; the pairs of one slab are one row's array.
    """
    numbered = slabs.select("key", "slab", "low", "high", (F.row_number().over(Window.partitionBy("key").orderBy("slab")) - 1).alias("i"))
    count = numbered.groupBy("key").agg(F.max("i").alias("last"))
    left = numbered.join(count, "key").withColumn("j", F.explode(F.sequence("i", "last")))
    right = numbered.select("key", F.col("slab").alias("other"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("i").alias("j"))
    mixed = F.expr("low < high or low_y < high_y or low <> low_y")
    return left.join(right, ["key", "j"]).where(mixed).select("key", "slab", "other")


def with_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with ``__row``, a key that each row has alone, in the order of ``doc_id`` with null last.

    Where all ids are there and differ, it is the id itself; else the rows are numbered in a written table.  They are
    sorted by id and place, so an id that many rows share is spread over tasks.
    """
    n = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n[0] == n[1] == n[2]:
        return docs.withColumn("__row", F.col("doc_id"))
    placed = docs.withColumn("__row", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "__row")
    return scratch.write(placed.withColumn("__row", F.monotonically_increasing_id()), "rows")


def only_used(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table(id, ...)`` that some pair ``(a, b)`` needs, so that only they are shuffled."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return narrow(table, ids, ["id"])
