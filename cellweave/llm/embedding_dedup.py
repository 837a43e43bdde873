"""Embedding near-duplicates by cosine, from int8 tile products with rigorous error bounds.

Each vector is scaled to unit length and quantised to int8 with a scale of its own; the length of its
quantisation error is known exactly.  For unit vectors x = q_x + e_x and y = q_y + e_y the cosine
differs from the product of the quantised vectors by at most |e_x| + (1 + |e_x|) |e_y|, so a tile
product plus that bound (and a margin for rounding) leaves out only pairs that are surely below the threshold.
The rest is recomputed in double precision from the vectors as stored.

Which tiles meet: up to ``PIVOTS`` vectors, a bounded sample, serve as pivots; a vector belongs to the cell of its
nearest pivot, and a large cell is split into blocks.  A cell's radius is its largest angle to its pivot.
By the triangle inequality a vector has to meet the blocks of another cell only if its angle to that pivot is at most the
radius plus the threshold angle.  No pair above the threshold is missed, whatever the sample was.

Equal vectors are compared once, by the smallest row among them, with their number as weight; what is found is given
back to every copy.  Groups of copies of over ``COMMON`` rows and over one row in ``COMMON`` are joined by
broadcast, of which there are fewer than ``COMMON``; the others by shuffle.

Tasks return a row a vector: its number of links in that pair of blocks, and the smallest row it
is connected with there.  Pairs never leave a task; ``components`` unites the rest.

Nulls: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different dimension do not link.  Rows that repeat a vec_id are vectors of their own (each
row is one vector).  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.components import components, small
from cellweave.storage import Scratch

THRESHOLD = 0.95
BLOCK = 2048
PIVOTS = 256
TILE = 1024
#: See above; fewer than this many vectors are broadcast.
COMMON = 5000
#: Over the rounding of float32 tile products of unit vectors and of the bound itself.
MARGIN = 1e-5


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, as squares of huge or tiny ones leave the range of doubles."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 rows, their scales, and the exact length of each row's error (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return q, scale, error


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``x`` and ``y`` (double) with cosine >= threshold, tile by tile."""
    ux, uy = unit_rows(x), unit_rows(y)
    (qx, sx, ex), (qy, sy, ey) = quantise(ux), quantise(uy)
    # an int8 product summed over 64 to 1000 dimensions is exact in float32, where the fast product is
    exact = x.shape[1] * 127 * 127 < 1 << 24
    kind = np.float32 if exact else np.float64
    qy_t = qy.astype(kind).T
    for i in range(0, len(x), TILE):
        a = qx[i : i + TILE].astype(kind)
        for j in range(0, len(y), TILE):
            low = a @ qy_t[:, j : j + TILE]
            low *= sx[i : i + TILE, None].astype(kind)
            low *= sy[None, j : j + TILE].astype(kind)
            # the largest bound of the tile first, each pair's own bound for what it leaves
            e, f = ex[i : i + TILE], ey[j : j + TILE]
            m, n = np.nonzero(low >= threshold - (e.max() + (1 + e.max()) * f.max()) - MARGIN)
            own = low[m, n] >= threshold - (e[m] + (1 + e[m]) * f[n]) - MARGIN
            m, n = m[own] + i, n[own] + j
            if len(m):
                cosine = np.einsum("ij,ij->i", ux[m], uy[n])
                ok = cosine >= threshold
                yield m[ok], n[ok]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index connected with each of ``n`` indices."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One pair of blocks: links and the smallest connected row of each vector."""
    pdf = pdf.sort_values("rid")
    x = np.array(pdf["embedding"].tolist(), np.float64)
    rid, side = pdf["rid"].to_numpy(), pdf["block"].to_numpy()
    links, weight = np.zeros(len(pdf), np.int64), pdf["copies"].to_numpy()
    left = np.flatnonzero(side == pdf["bi"].iloc[0])
    pairs = []
    if pdf["bi"].iloc[0] == pdf["bj"].iloc[0]:
        # tiles of the upper triangle only
        for i in range(0, len(x), TILE):
            for m, n in near_pairs(x[i : i + TILE], x[i:], threshold):
                keep = m < n
                pairs.append((m[keep] + i, n[keep] + i))
    else:
        right = np.flatnonzero(side == pdf["bj"].iloc[0])
        if len(left) and len(right):
            pairs = [(left[m], right[n]) for m, n in near_pairs(x[left], x[right], threshold)]
    for m, n in pairs:
        np.add.at(links, m, weight[n])
        np.add.at(links, n, weight[m])
    out = pd.DataFrame({"rid": rid, "links": links, "root": rid[_roots(len(rid), pairs)]})
    return out[out["links"] > 0]


def embedding_dedup(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``vec_id, n_links, component_id, kept``, a row a vector."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("usable", usable)
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    grouped = rows.where("usable").groupBy("embedding")
    kinds = scratch.write(grouped.agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("vec_id").alias("low_id")), "kinds")
    use = kinds.select("rid", "copies", "embedding", F.size("embedding").alias("dim"))
    parts = [_compared(use.where(F.col("dim") == d.dim).drop("dim"), d.n, scratch, threshold, block, pivots) for d in use.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    alone = ["vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    done = rows.where("not usable").select(*alone)
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        found = scratch.write(found, "found")
        comp = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")).where("a <> b"), scratch).toDF("rid", "comp")
        links = found.groupBy("rid").agg(F.sum("links").alias("links"))
        linked = kinds.join(links, "rid", "left").join(comp, "rid", "left").where("links is not null or copies > 1")
        own = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        linked = scratch.write(linked.select("embedding", "copies", own, F.coalesce("comp", "rid").alias("comp"), "low_id"), "linked")
        smallest = scratch.write(linked.groupBy("comp").agg(F.min("low_id").alias("component_id")), "smallest")
        told = linked.join(small(smallest, 32), "comp").select("embedding", "copies", "n_links", "component_id")
        common = F.col("copies") > max(COMMON, rows.count() // COMMON)
        heavy, rare = (told.where(c).select("embedding", F.lit(True).alias("found"), "n_links", "component_id") for c in (common, ~common))
        often = scratch.write(rows.where("usable").select("vec_id", "embedding").join(F.broadcast(heavy), "embedding", "left"), "often")
        rest = often.where("found is null").select("vec_id", "embedding").join(rare, "embedding", "left")
        for met in (often.where("found"), rest.where("found")):
            done = done.union(met.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")))
        done = done.union(rest.where("found is null").select(*alone))
    return done.withColumn("kept", F.expr("vec_id <=> component_id"))


def _compared(use: DataFrame, n: int, scratch: Scratch, threshold: float, block: int, pivots: int) -> DataFrame:
    """The links of the kinds of vectors ``use(rid, embedding, copies)`` of one dimension: ``(rid, links, root)``, a row for each vector and pair of blocks with links."""
    wanted = max(1, min(pivots, -(-n // block)))
    drawn = use.orderBy(F.xxhash64("rid"), "rid").limit(wanted).collect()
    centre = unit_rows(np.array([r.embedding for r in drawn], np.float64))

    kind = use.schema["embedding"].dataType.simpleString()

    def angles(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array(pdf["embedding"].tolist(), np.float64)
        return np.arccos(np.clip(unit_rows(x) @ centre.T, -1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = angles(pdf)
                cell = a.argmin(axis=1)
                yield pd.DataFrame({"rid": pdf["rid"], "copies": pdf["copies"], "cell": cell.astype(np.int32), "angle": a[np.arange(len(a)), cell], "embedding": pdf["embedding"]})

    celled = scratch.write(use.mapInPandas(assign, f"rid long, copies long, cell int, angle double, embedding {kind}"), "cells")
    stats = {r.cell: r for r in celled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("m")).collect()}  # at most `pivots` rows
    cells = sorted(stats)
    split = {c: -(-stats[c].m // block) for c in cells}
    first = dict(zip(cells, np.cumsum([0] + [split[c] for c in cells])[:-1].tolist(), strict=True))
    reach = np.array([stats[c].radius for c in cells]) + np.arccos(threshold) + 1e-6

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            meets = angles(pdf)[:, cells] <= reach[None, :]
            for r in range(0, len(pdf), 256):  # bounded output batches
                out = {"rid": [], "copies": [], "block": [], "bi": [], "bj": [], "embedding": []}
                for rid, w, c, e, ok in zip(pdf["rid"][r : r + 256], pdf["copies"][r : r + 256], pdf["cell"][r : r + 256], pdf["embedding"][r : r + 256], meets[r : r + 256], strict=True):
                    mine = first[c] + rid * 0x9E3779B1 % 4294967311 % split[c]
                    for k in np.flatnonzero(ok):
                        for other in range(first[cells[k]], first[cells[k]] + split[cells[k]]):
                            for name, v in (("rid", rid), ("copies", w), ("block", mine), ("bi", min(mine, other)), ("bj", max(mine, other)), ("embedding", e)):
                                out[name].append(v)
                yield pd.DataFrame(out)

    dealt = celled.select("rid", "copies", "cell", "embedding").mapInPandas(spread, f"rid long, copies long, block int, bi int, bj int, embedding {kind}")
    return dealt.groupBy("bi", "bj").applyInPandas(lambda pdf: _compare(pdf, threshold), "rid long, links long, root long")
