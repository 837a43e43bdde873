"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of word n-grams (five words, white space between words, case kept; a text of one to
four words is one shorter gram; a text without words has no grams and links with nothing).  Texts that
are equal form one class and are compared once.  Classes meet in MinHash bands; a candidate pair's
MinHash values are compared a block at a time, and it is dropped when the posterior probability of
reaching the threshold (Beta prior, binomial matches) is below the tolerance.  The survivors are
verified on their gram sets exactly.

To find every link without listing all pairs of a large group, the join runs in two parts:

1. components: ``components.link`` tests pairs across components only.  Large buckets are compared a pair of
   slabs at a time, signatures and gram sets together, and a slab pair gives a spanning forest of its links, so
   rows follow the members and not their pairs.  A slab is bounded in members and in bytes of gram sets;
2. links: a link lies inside one component, so each component is cut into blocks of members and each
   pair of blocks is compared once, in arrays of at most ``BLOCK`` by ``BLOCK`` pairs.  A component has up to ``BLOCKS``
   blocks, and more where a block would hold over ``MOST`` members or ``MOST_BYTES`` of gram sets, so a task's memory does
   not grow with the component.  Rows that leave a task are counts per class, never pairs.

Nulls: a null text is a text without words; a null doc_id is a row like others, last in order.  Repeated ids
are separate rows.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.components import link, narrow, only_used, share, slab_pairs, small, tiled, with_rows
from cellweave.storage import Scratch

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
HASHES = 96
STEP = 16
TOLERANCE = 1e-4
PRIOR = (1.0, 1.0)
BLOCK, BLOCKS = 128, 16
#: Members of a block on average, at most, whatever the component's size.
MOST, MOST_BYTES = 1024, 48 << 20
#: Weight of a slab of a large bucket: a member weighs 1, and 1 more for each ``GRAMS_BYTES`` of its gram set.
SLAB, GRAMS_BYTES = 256, 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _seeds(n: int) -> np.ndarray:
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words; a bounded cache that is emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _MIX + h[i : i + len(out)])
    return np.unique(out)


def minhash(g: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values, as the top 32 bits of each minimum; in slices, so memory stays small for long texts."""
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    seeds = _seeds(hashes)
    for i in range(0, len(g), 2048):
        part = g[i : i + 2048]
        x = (part[:, None] ^ (part[:, None] >> np.uint64(29))) * seeds[None, :]
        np.minimum(best, x.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _beta_tail(t: float, a: float, b: float) -> float:
    """P(X >= t) for X ~ Beta(a, b), by Simpson's rule."""
    x = np.linspace(0.0, 1.0, 4001)[1:-1]
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    p = np.exp(log - log.max())
    return float(p[x >= t].sum() / p.sum())


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """For each number of compared values, the least number of matches that keeps a pair."""
    out = {}
    for n in range(step, hashes + 1, step):
        out[n] = next((m for m in range(n + 1) if _beta_tail(threshold, PRIOR[0] + m, PRIOR[1] + n - m) >= tolerance), n)
    return out


def _signed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, __row, text)`` -> written ``(doc_id, __row, h1, h2, sig)``: a 128-bit text hash and the MinHash values (null without words)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                g = grams(text)
                h = xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))
                rows.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), minhash(g).tobytes() if len(g) else None))
            yield pd.concat([pdf[["__id", "__row"]], pd.DataFrame(rows, columns=["h1", "h2", "sig"], index=pdf.index)], axis=1)

    # ids pass through Python as text, which holds null and every long
    made = docs.select(F.col("doc_id").cast("string").alias("__id"), "__row", "text").mapInPandas(sign, "__id string, __row long, h1 long, h2 long, sig binary")
    return scratch.write(made.select(F.col("__id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "__row", "h1", "h2", "sig"), "signed")


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            s = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), HASHES)[:, : BANDS * ROWS].astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(pdf), 1), np.uint64)
            for r in range(ROWS):
                key = _mix(key * _MIX + s[:, r::ROWS])
            yield pd.DataFrame({"key": key.ravel().view(np.int64), "id": np.repeat(pdf["id"].to_numpy(), BANDS)})


def _members(classes: DataFrame) -> DataFrame:
    return classes.select("id", "sig").mapInPandas(_bands, "key long, id long")


def _gram_table(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The gram sets of the wanted ``(id, __row)`` only, from a second reading of their texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "grams": [grams(text).tobytes() for text in pdf["text"]]})

    found = narrow(docs.select("__row", "text"), wanted.select("id", "__row"), ["__row"])
    return scratch.write(found.select("id", "text").mapInPandas(cut, "id long, grams binary"), "grams")


def prune(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Rows of two signature arrays that survive every step of the incremental comparison."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for n, least_n in least.items():
        if not len(alive):
            break
        matches = matches + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
        keep = matches >= least_n
        alive, matches = alive[keep], matches[keep]
    return alive


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _verifier(classes: DataFrame, gram_table: DataFrame, scratch: Scratch, threshold: float):
    least = least_matches(threshold)

    def pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["sig_a"]), np.uint32).reshape(-1, HASHES)
                y = np.frombuffer(b"".join(pdf["sig_b"]), np.uint32).reshape(-1, HASHES)
                yield pdf[["a", "b"]].iloc[prune(x, y, least)]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(pdf["grams_a"], pdf["grams_b"], strict=True)]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        sig_a = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        sig_b = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        left = scratch.write(pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInPandas(pruned, "a long, b long"), "left")
        used = only_used(gram_table, left)
        g_a = used.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
        g_b = used.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
        return left.join(g_a, "a").join(g_b, "b").select("a", "b", "grams_a", "grams_b").mapInPandas(exact, "a long, b long")

    return verify


def _local_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Membership matrix over the grams that tell sets apart: those in one set only, or in all, are left out (counted apart)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = (counts > 1) & (counts < len(sets))
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    rows, cols = owner[use], column[inverse[use]]
    common = int((counts == len(sets)).sum()) if len(sets) > 1 else 0
    inter = np.full((len(sets), len(sets)), float(common), np.float32)
    width = int(shared.sum())
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for start in range(0, width, 4096):
        lo, hi = np.searchsorted(cols, [start, start + 4096])
        m = np.zeros((len(sets), min(4096, width - start)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - start] = 1
        inter += m @ m.T
    return inter


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``i`` and ``j``: one by one if they are few, else all at once."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    return _local_sets(sets)[i, j].round().astype(np.int64)


def _forest(ids: np.ndarray, comps: np.ndarray, sig: np.ndarray, grams: list[bytes], cut: int, threshold: float, least: dict[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links across components between the members before ``cut`` and the others, or among all if ``cut`` is 0.

    All members come from one bucket.  A pair that shares an earlier band is left to the bucket of that band.
    """
    n = len(ids)
    i, j = np.triu_indices(n, 1) if not cut else (x.ravel() + o for x, o in zip(np.indices((cut, n - cut)), (0, cut), strict=True))
    across = comps[i] != comps[j]
    i, j = i[across], j[across]
    shared = (sig[:, : BANDS * ROWS] == sig[:1, : BANDS * ROWS]).reshape(n, BANDS, ROWS).all(axis=(0, 2))
    for band in range(int(shared.argmax())):  # none if no band is shared by all, as two keys have collided
        at = slice(band * ROWS, (band + 1) * ROWS)
        later = (sig[i, at] != sig[j, at]).any(axis=1)
        i, j = i[later], j[later]
    keep = prune(sig[i], sig[j], least)
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets = [np.frombuffer(grams[x], np.uint64) for x in used]
    size = np.array([len(s) for s in sets])
    x, y = place[: len(i)], place[len(i) :]
    common = _common(sets, x, y)
    ok = common >= threshold * (size[x] + size[y] - common) - 1e-9
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for a, b in zip(i[ok], j[ok], strict=True):
        p, q = find(int(comps[a])), find(int(comps[b]))
        if p != q:
            root[p] = q
            out.append((int(ids[a]), int(ids[b])))
    return out


def _large(near: DataFrame, gram_table: DataFrame, scratch: Scratch, threshold: float):
    """Links of large buckets for ``components.link``: a row is a pair of slabs, whatever the bucket's size."""
    least = least_matches(threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                same = r.slab == r.other
                ids, comps, sig, grams = ([*x] if same else [*x, *y] for x, y in ((r.id, r.id_y), (r.comp, r.comp_y), (r.sig, r.sig_y), (r.grams, r.grams_y)))
                sig = np.frombuffer(b"".join(sig), np.uint32).reshape(len(ids), HASHES)
                found += _forest(np.array(ids), np.array(comps), sig, grams, 0 if same else len(r.id), threshold, least)
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def large(left: DataFrame) -> DataFrame:
        full = left.join(near, "id").join(gram_table, "id").withColumn("w", F.expr(f"1 + octet_length(grams) div {GRAMS_BYTES}"))
        fields = ("id", "comp", "sig", "grams")
        slabs = tiled(scratch.write(full, "placed"), "w", SLAB).groupBy("key", "slab").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.collect_list(F.struct(*fields)).alias("m"))
        slabs = scratch.write(slabs.select("key", "slab", "low", "high", *[F.col(f"m.{c}").alias(c) for c in fields]), "slabs")
        met = slab_pairs(slabs).join(slabs.drop("low", "high"), ["key", "slab"])
        right = slabs.select("key", F.col("slab").alias("other"), *[F.col(c).alias(f"{c}_y") for c in fields])
        return met.join(right, ["key", "other"]).mapInPandas(compare, "a long, b long")

    return large


def _blocks(m: Column, size: Column) -> Column:
    """The number of blocks of a component of ``m`` members whose gram sets have ``size`` bytes."""
    by_count = F.when(m <= BLOCK, 1).otherwise(F.greatest(F.least(F.ceil(m / BLOCK), F.lit(BLOCKS)), F.ceil(m / MOST)))
    return F.greatest(by_count, F.ceil(size / MOST_BYTES)).cast("int")


def _count_block(pdf: pd.DataFrame, threshold: float, least: dict[int, int]) -> pd.DataFrame:
    """Links between (or inside) the two blocks of one block pair: how many rows each class links with.

    The pairs are listed and compared a tile of ``BLOCK`` by ``BLOCK`` members at a time.
    """
    pdf = pdf.sort_values(["block", "id"])
    ids, copies, block, grams = (pdf[c].to_numpy() for c in ("id", "copies", "block", "grams"))
    n = len(ids)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(n, HASHES)
    same = bool(pdf["bi"].iloc[0] == pdf["bj"].iloc[0])
    cut = n if same else int(np.searchsorted(block, block[0], "right"))
    links = np.zeros(n, np.int64)
    if not same and block[0] == block[-1]:  # the other block has no members
        return pd.DataFrame({"id": ids, "links": links})
    for x in range(0, cut, BLOCK):
        rows = np.arange(x, min(x + BLOCK, cut))
        for y in range(x if same else cut, n, BLOCK):
            if x == y:
                i, j = (rows[k] for k in np.triu_indices(len(rows), 1))
                members = rows
            else:
                others = np.arange(y, min(y + BLOCK, n))
                i, j = np.repeat(rows, len(others)), np.tile(others, len(rows))
                members = np.concatenate([rows, others])
            keep = prune(sig[i], sig[j], least)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            sets = [np.frombuffer(grams[k], np.uint64) for k in members]
            size = np.array([len(s) for s in sets])
            p, q = np.searchsorted(members, i), np.searchsorted(members, j)
            inter = _common(sets, p, q)
            ok = inter >= threshold * (size[p] + size[q] - inter) - 1e-9
            np.add.at(links, i[ok], copies[j[ok]])
            np.add.at(links, j[ok], copies[i[ok]])
    return pd.DataFrame({"id": ids, "links": links})


def ngram_join(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, class_id, n_links, group_id)``, one row per document.

    ``class_id`` is the smallest doc_id with an equal text, ``n_links`` the number of other rows whose
    gram sets are at least ``threshold`` similar (equal texts with words included), ``group_id`` the
    smallest doc_id reachable over links.
    """
    return _joined(with_rows(docs.select("doc_id", "text"), scratch), scratch, threshold).drop("__row", "group_row")


def _grouped(docs: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of ``(doc_id, __row, text)``: the signed rows, the classes of equal texts, the components of linked classes, and the signatures and gram sets of those in shared buckets."""
    signed = _signed(docs, scratch)
    classes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.min("__row").alias("class_row"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    worded = classes.where("sig is not null")
    shared = share(_members, worded, scratch)
    wanted = scratch.write(worded.select("id", F.col("class_row").alias("__row")).join(shared.select("id").distinct(), "id", "left_semi"), "wanted")
    gram_table = _gram_table(docs, wanted, scratch)
    near = scratch.write(worded.select("id", "sig").join(small(wanted.select("id"), 24), "id"), "near")
    comp = link(shared, _verifier(near, gram_table, scratch, threshold), _large(near, gram_table, scratch, threshold), scratch)
    return signed, classes, comp, near, gram_table


def _joined(docs: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``ngram_join`` of ``(doc_id, __row, text)`` with ``__row`` and ``group_row``, the first row reachable over links."""
    signed, classes, comp, near, gram_table = _grouped(docs, scratch, threshold)
    least = least_matches(threshold)
    member = comp.join(classes.select("id", "class_id", "class_row", "copies"), "id")
    blocked = member.join(near, "id").join(gram_table, "id")
    blocked = scratch.write(blocked, "members")
    sizes = blocked.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.octet_length("grams")).alias("size"))
    sizes = sizes.select("comp", _blocks(F.col("m"), F.col("size")).alias("blocks"))
    dealt = blocked.join(small(sizes, 32), "comp").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("id", "copies", "comp", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "sig", "grams")
    counted = paired.groupBy("comp", "bi", "bj").applyInPandas(lambda pdf: _count_block(pdf, threshold, least), "id long, links long")
    links = counted.groupBy("id").agg(F.sum("links").alias("links"))
    group = blocked.groupBy("comp").agg(F.min("class_id").alias("group_id"), F.min("class_row").alias("group_row"))
    linked = comp.join(group, "comp").join(links, "id", "left").select("id", "group_id", "group_row", "links")
    facts = classes.join(linked, "id", "left").select(
        "h1", "h2", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("group_row", "class_row").alias("group_row"),
        F.when(F.col("sig").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
    )
    return signed.select("doc_id", "__row", "h1", "h2").join(facts, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "group_id", "__row", "group_row")


def one_per_group(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one row of each linked group: that of the smallest doc_id.

    A row without words stays unless its text equals that of an earlier row.  Links are not counted, only followed.
    """
    rows = with_rows(docs, scratch)
    signed, classes, comp, _, _ = _grouped(rows.select("doc_id", "__row", "text"), scratch, threshold)
    placed = classes.select("id", "h1", "h2", "class_row", "copies").join(comp, "id", "left")
    first = placed.where("comp is not null").groupBy("comp").agg(F.min("class_row").alias("group_row"))
    # only classes that are linked or repeated can lose a row
    judged = placed.where("comp is not null or copies > 1").join(first, "comp", "left").select("h1", "h2", F.coalesce("group_row", "class_row").alias("stays"))
    gone = signed.select("__row", "h1", "h2").join(judged, ["h1", "h2"]).where("__row <> stays").select("__row")
    return rows.join(small(scratch.write(gone, "gone"), 24), "__row", "left_anti").select(*docs.columns)
