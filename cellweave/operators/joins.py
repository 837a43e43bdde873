"""Identifier mapping, one-to-one filtering and interval joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_genes(genes: DataFrame, mapping: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``mapped``: the id itself where the vocabulary has it, else its mapping, if the vocabulary has that; else null.

    ``mapping(gene_id, target)`` must not repeat a gene_id.
    """
    here = vocab.select(F.col("token").alias("gene_id"), F.lit(True).alias("here"))
    there = vocab.select(F.col("token").alias("target"), F.lit(True).alias("there"))
    return genes.join(here, "gene_id", "left").join(mapping, "gene_id", "left").join(there, "target", "left").select(*genes.columns, F.when(F.col("here"), F.col("gene_id")).when(F.col("there"), F.col("target")).alias("mapped"))


def strict_bijection(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs in which either side has one partner only; counted by aggregation, so a gene with many partners is no window."""
    clean = pairs.select(a, b).distinct()
    one_a = clean.groupBy(a).agg(F.count("*").alias("n")).where("n = 1").select(a)
    one_b = clean.groupBy(b).agg(F.count("*").alias("n")).where("n = 1").select(b)
    return clean.join(one_a, a, "left_semi").join(one_b, b, "left_semi").select(a, b)


def ambiguity(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``reason``: null for a one-to-one pair, else which side has more partners."""
    clean = pairs.select(source, target).distinct()
    s = clean.groupBy(source).agg(F.count("*").alias("ns"))
    t = clean.groupBy(target).agg(F.count("*").alias("nt"))
    why = F.when(F.col("ns") > 1, "source_to_many").when(F.col("nt") > 1, "many_to_target")
    return clean.join(s, source).join(t, target).select(source, target, why.alias("reason"))


def compose_bridge(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left(a, via)`` and ``right(via, b)`` joined over ids that are unique on both links."""
    once_l = left.groupBy("via").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select("via", "a")
    once_r = right.groupBy("via").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("via", "b")
    return once_l.join(once_r, "via").select("a", "b").distinct()


def _records(x: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each prefix: its largest ``x``, how many have it, and the least ``rank`` of those."""
    top = np.maximum.accumulate(x)
    new = np.r_[True, top[1:] > top[:-1]]
    at = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    is_top = x == top
    seen = np.cumsum(is_top)
    big = np.int64(1) << 32
    # a later record lowers all ranks by more than there are, so the running minimum starts anew
    low = np.minimum.accumulate(np.where(is_top, rank, big - 1) - np.cumsum(new) * big) + np.cumsum(new) * big
    return top, seen - seen[at] + 1, low


def _before(key: np.ndarray, x: np.ndarray, rank: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_records`` of the rows with ``key < upto`` of each query; a count of 0 where there are none."""
    order = np.argsort(key, kind="stable")
    at = np.searchsorted(key[order], upto)
    top, n, low = (np.r_[v[:1], v] for v in _records(x[order], rank[order]))
    return top[at], np.where(at > 0, n[at], 0), low[at]


def _dominated(u: np.ndarray, v: np.ndarray, x: np.ndarray, rank: np.ndarray, max_u: np.ndarray, max_v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the rows with ``u < max_u`` and ``v < max_v``: the rows by ``u`` are cut in blocks of 1, 2, 4, ..., and a query's prefix is one block of some of these sizes."""
    order = np.argsort(u, kind="stable")
    prefix = np.searchsorted(u[order], max_u)
    values, places = np.unique(v[order], return_inverse=True)
    limit, x, rank = np.searchsorted(values, max_v), x[order], rank[order]
    best = np.full(len(max_u), np.iinfo(np.int64).min), np.zeros(len(max_u), np.int64), np.zeros(len(max_u), np.int64)
    for level in range(len(u).bit_length()):
        asks = np.flatnonzero(prefix >> level & 1)
        if not len(asks):
            continue
        block = np.arange(len(u)) >> level
        key = block * (len(values) + 1) + places
        by = np.argsort(key, kind="stable")
        # a block's values stand above those of all blocks before it, so its records are its own
        span = int(x.max() - x.min()) + 1
        top, n, low = _records(x[by] - x.min() + block[by] * span, rank[by])
        mine = (prefix[asks] >> level + 1) << 1
        at = np.searchsorted(key[by], mine * (len(values) + 1) + limit[asks]) - 1
        there = (at >= 0) & (block[by[at]] == mine)
        asks, at, mine = asks[there], at[there], mine[there]
        _merge(best, asks, top[at] - mine * span + x.min(), n[at], low[at])
    return best


def _merge(best: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, x: np.ndarray, n: np.ndarray, low: np.ndarray) -> None:
    """Join what other candidates gave for ``rows`` into ``best``: the larger ``x``; of equal ones the counts add up."""
    more, same = x > best[0][rows], x == best[0][rows]
    best[2][rows] = np.where(more, low, np.where(same, np.minimum(low, best[2][rows]), best[2][rows]))
    best[1][rows] = np.where(more, n, best[1][rows] + np.where(same, n, 0))
    best[0][rows] = np.where(more, x, best[0][rows])


def best_overlaps(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each interval ``a..b``: its best overlap with those of ``s..e`` (0: none), how many have it, and the least rank of these.

    Sorts and searches only, so work grows as n log n squared and not with the pairs.  An interval is met by ones that hold
    it, that end in it, that start in it and reach its end, or that lie inside it.
    """
    best = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if not len(s) or not len(a):
        return best
    every = np.arange(len(a))
    _, n, low = _dominated(s, -e, np.zeros(len(s), np.int64), rank, a + 1, 1 - b)
    held = n > 0
    _merge(best, every[held], (b - a + 1)[held], n[held], low[held])
    rest = every[~held]
    if len(rest):
        a, b = a[rest], b[rest]
        # none holds the interval: of those that start by a all end before b, of those that end at b or later all start after a
        end, n, low = _before(s, e, rank, a + 1)
        ok = (n > 0) & (end >= a)
        _merge(best, rest[ok], (end - a + 1)[ok], n[ok], low[ok])
        start, n, low = _before(-e, -s, rank, 1 - b)
        ok = (n > 0) & (-start <= b)
        _merge(best, rest[ok], (b + start + 1)[ok], n[ok], low[ok])
        size, n, low = _dominated(-s, e, e - s + 1, rank, -a, b)
        ok = n > 0
        _merge(best, rest[ok], size[ok], n[ok], low[ok])
    return best


def interval_overlap(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Best overlap of each left interval ``(id, seq, start, end)`` (ends included) with right ones of the same sequence.

    Each interval is listed under the buckets of ``width`` that it touches, and a pair counts only in the bucket where its
    overlap starts, so no pair is counted twice.  A bucket's best overlaps come from sorts and searches inside a task
    (``best_overlaps``); pairs are never made.  Ties for the best overlap are told as ambiguous.
    """

    def bucketed(rows: DataFrame, side: bool) -> DataFrame:
        touched = F.sequence(*(F.expr(f"(`{c}` - pmod(`{c}`, {width})) div {width}") for c in ("start", "end")))
        named = [F.lit(None).cast(kind).alias("hit"), F.col("id")] if side else [F.col("id").alias("hit"), F.lit(None).cast(left.schema["id"].dataType).alias("id")]
        rows = rows.where("start <= end and seq is not null" + (" and id is not null" if side else ""))
        return rows.select("seq", F.explode(touched).alias("bucket"), F.lit(side).alias("asks"), *named, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    kind = right.schema["id"].dataType

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        q, r = table.filter(pa.array(asks)), table.filter(pa.array(~asks)).sort_by("hit")
        a, b, s, e = (t.column(c).to_numpy() for t in (q, r) for c in ("start", "end"))
        first = table.column("bucket")[0].as_py() * width
        found = tuple(np.zeros(len(a), np.int64) for _ in range(3))
        for mine, theirs in ((a >= first, s == s), (a < first, s >= first)):
            m, t = np.flatnonzero(mine), np.flatnonzero(theirs)
            # nulls are sorted last, so the least rank is an id if any is there
            for out, got in zip(found, best_overlaps(a[m], b[m], s[t], e[t], t), strict=True):
                out[m] = got
        some = np.flatnonzero(found[0])
        hits = r.column("hit").take(pa.array(found[2][some])) if len(some) else r.column("hit").slice(0, 0)
        sizes = (e - s + 1)[found[2][some]]
        return pa.table({"id": q.column("id").take(pa.array(some)), "overlap": found[0][some], "n": found[1][some], "hit": hits, "size": (b - a + 1)[some], "hit_size": sizes})

    schema = T.StructType([left.schema["id"], *(T.StructField(c, t) for c, t in (("overlap", T.LongType()), ("n", T.LongType()), ("hit", kind), ("size", T.LongType()), ("hit_size", T.LongType())))])
    met = bucketed(left, True).union(bucketed(right, False).select("seq", "bucket", "asks", "hit", "id", "start", "end")).groupBy("seq", "bucket").applyInArrow(best, schema)
    tied = met.groupBy("id", "overlap").agg(F.sum("n").alias("n"), F.min("hit").alias("hit"), F.min("size").alias("size"), F.min_by("hit_size", "hit").alias("hit_size"))
    top = tied.groupBy("id").agg(F.max_by(F.struct("overlap", "n", "hit", "size", "hit_size"), "overlap").alias("t")).select("id", "t.*")
    return top.select("id", F.when(F.col("n") == 1, F.col("hit")).alias("hit"), "overlap", (F.col("n") > 1).alias("ambiguous"), F.least(F.col("overlap") / F.col("size"), F.col("overlap") / F.col("hit_size")).alias("reciprocal"))


def shared_keys(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of groups and the number of distinct keys they share."""
    a = rows.select(F.col(group).alias("group_a"), key).distinct()
    b = a.select(F.col("group_a").alias("group_b"), key)
    return a.join(b, key).where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("n_shared"))

