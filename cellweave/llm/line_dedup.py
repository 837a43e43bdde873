"""Fuzzy line deduplication: one line stays of each group of near-equal lines, over all documents.

Native: DataFrame expressions only.  A text is split at line feeds; a line is compared in lower case
without outer white space.  Its set is that of its character shingles (``Q`` UTF-16 units; a shorter line has none and is
near its equals only).  Two lines are near when the Jaccard similarity of their sets is ``threshold`` or more.

1. Equal lines form one class by a 128-bit hash; only hashes and positions are shuffled.
2. Each class has ``VALUES`` MinHash values over all its shingles.  A shingle is hashed to 31 bits; value i is the hash of the set that is
   nearest to a constant c_i when they are compared by exclusive or, so that the set's shingles are equally likely.  The values are the
   points of the affine plane of nine points and the bands its twelve lines: any five matching values hold a line, so a pair of
   similarity 0.8 meets with probability 0.990, one of 0.85 with 0.997.  (Twelve disjoint bands of three would need 36 values.)
   A pair is a candidate if ``ENOUGH`` values match, one more than a band (0.0004 of the pairs at 0.8 have no more).  Texts are
   read only for members of a bucket that are alike to another one, and for those of large buckets.
3. ``components.link`` tests candidates on their whole shingle sets and unites them.  Each line has a mark, a bit map in which every
   shingle sets one bit: bits that two marks do not share bound the shingles that the sets do not, so it leaves out only pairs
   that are not near.  Pairs that differ in one short stretch are near by the lengths of what they have in common at both ends;
   sets are made for the others only.  A large bucket is first split by the rarest values of its members.  The members that this does not part are
   held as differences from the bucket's first line, so two of them are compared exactly by their few differing shingles.
4. Of each component, the line first in (doc_id, row, position) stays; blank lines always stay.

Nulls: a null text has no lines and stays null; a null doc_id comes last.  Rows that repeat a doc_id, or have
none, are documents of their own, in no set order among themselves.  An empty table gives an empty result.  Extra columns
ride along untouched; what the operator adds is one struct, ``line_dedup``, which replaces a column of that name.
Columns named ``gone`` or starting with ``__`` are used inside and must not come in.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.components import SMALL_BYTES, link, narrow, only_used, share, slab_pairs, small, tiled, with_rows
from cellweave.storage import Scratch

Q = 9
#: MinHash values of a line, and how many of them match in candidates.
VALUES, ENOUGH = 9, 4
#: The twelve lines of the affine plane over three elements, as points 3 x + y.
BANDS = [(3 * x, 3 * x + 1, 3 * x + 2) for x in range(3)] + [tuple(3 * x + (a * x + b) % 3 for x in range(3)) for a in range(3) for b in range(3)]
THRESHOLD = 0.8
#: Weight of a slab of a large bucket: a member weighs 1, and 1 more for each ``SHINGLES`` differing shingles.
SLAB, SHINGLES = 256, 512
#: Bytes of slabs that one write may shuffle to its pairs of slabs; more pairs are compared in rounds, each freed before the next.
ROUND = 512 << 20
#: Members of a bucket whose likely pairs may leave it as rows.
MIDDLE = 32
#: Shingles that one row signs, and bits of a line's mark.
STRIDE, MARK = 8, 1024
#: Bits of the map of wanted lines for each of them, and 64-bit words of one of its rows.
PLACE_BITS, CHUNK = 16, 1024
#: Constants that lie far apart, one a MinHash value.
POINTS = [(i * 0x9E3779B1) % (1 << 31) for i in range(1, VALUES + 1)]
#: Values are compared by 15 bits, four in a long; the two masks hold the lower 14 bits of each and the last one.
LANE, LOWER, UPPER = 15, sum(0x3FFF << 15 * k for k in range(4)), sum(0x4000 << 15 * k for k in range(4))


def lines_of(docs: DataFrame) -> DataFrame:
    """``(__row, text)`` -> ``(__row, pos, line)`` with lines as they are compared; blank lines are left out."""
    lines = docs.select("__row", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    return lines.select("__row", "pos", _trim("line").alias("line")).where("line <> ''")


def _trim(line: str) -> Column:
    # trimming looks at every character, and few lines need it
    ends = " or ".join(f"startswith({line}, '{c}') or endswith({line}, '{c}')" for c in (" ", "\\t", "\\r"))
    return F.expr(f"if({ends}, trim(both ' \\t\\r' from {line}), {line})")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2")]


def signed(docs: DataFrame) -> DataFrame:
    """``(h1, h2, m0, m1, ...)``, a row for each distinct line of ``Q`` characters or more.

    Shingles are cut from two-byte characters, so each is a slice of bytes.  The minima are grouped by the line's hash, so
    one hash aggregation (merged map-side) yields both the classes and their signatures.  A row has ``STRIDE`` shingles, the last
    of a line repeats its last one; the aggregation is looked up once for all of them.
    """
    coded = lines_of(docs).select(*_hashes(), F.encode("line", "UTF-16BE").alias("c")).where(f"octet_length(c) >= {2 * Q}")
    last = f"octet_length(c) - {2 * Q - 1}"
    cut = coded.select("h1", "h2", "c", F.expr(last).alias("last"), F.explode(F.expr(f"sequence(1, {last}, {2 * STRIDE})")).alias("i"))
    hashed = cut.select("h1", "h2", *[F.expr(f"xxhash64(substring(c, least(i + {2 * j}, last), {2 * Q})) & 2147483647").alias(f"x{j}") for j in range(STRIDE)])

    def least(c: int) -> Column:
        values = [F.col(f"x{j}").bitwiseXOR(F.lit(c).cast("long")) for j in range(STRIDE)]
        return F.least(*values) if STRIDE > 1 else values[0]

    return hashed.groupBy("h1", "h2").agg(*[F.min(least(c)).alias(f"m{i}") for i, c in enumerate(POINTS)])


def _lanes() -> list[Column]:
    """``s0, s1, ...``: the signature, ``LANE`` bits of each value."""
    return [F.expr(" | ".join(f"shiftleft(m{i + k} & {(1 << LANE) - 1}, {LANE * k})" for k in range(4) if i + k < VALUES)).alias(f"s{i // 4}") for i in range(0, VALUES, 4)]


def _alike(a: str, b: str) -> str:
    """Whether ``ENOUGH`` values of two lines match, with the fields of a signature written into ``a`` and ``b``; by chance in 15 bits a few more do."""
    differ = [f"({a.format(f's{i}')} ^ {b.format(f's{i}')})" for i in range(-(-VALUES // 4))]
    return " + ".join(f"bit_count(((({d} & {LOWER}L) + {LOWER}L) | {d}) & {UPPER}L)" for d in differ) + f" <= {VALUES - ENOUGH}"


def _pruned(shared: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Written ``shared`` without the members of buckets of up to ``MIDDLE`` that are alike to no other member of theirs."""
    large = shared.groupBy("key").agg(F.count("*").alias("n"), F.max("parts").alias("most")).where(f"n > {MIDDLE} or most > 1").select("key")
    large = small(scratch.write(large, "many"), 24)
    held = shared.join(large, "key", "left_anti").join(classes.select("id", *_lanes()), "id")
    held = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", *[f"s{i}" for i in range(-(-VALUES // 4))]))).alias("x"))
    alike = F.expr(f"transform(filter(x, p -> exists(x, q -> p.id <> q.id and {_alike('p.{}', 'q.{}')})), p -> p.id)")
    told = held.select("key", alike.alias("y")).where("size(y) > 0")
    few = told.select("key", F.inline(F.expr("transform(y, (p, i) -> named_struct('id', p, 'prev', if(i > 0, y[greatest(i - 1, 0)], null), 'head', y[0]))")))
    return scratch.write(few.withColumn("parts", F.lit(1)).union(shared.join(large, "key", "left_semi").select("key", "id", "prev", "head", "parts")), "shared")


def _keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in band]) for b, band in enumerate(BANDS)])


def _members(classes: DataFrame) -> DataFrame:
    return classes.select("id", F.explode(_keys()).alias("key")).select("key", "id")


def _set(coded: str) -> Column:
    """The distinct shingle hashes of a line of ``Q`` characters or more, as two-byte characters.

    The bytes are bound to a variable of an outer function, as the inner one would copy a column's bytes for each shingle.
    """
    return F.expr(f"array_distinct(transform(array({coded}), c -> transform(sequence(1, octet_length(c) - {2 * Q - 1}, 2), i -> xxhash64(substring(c, i, {2 * Q}))))[0])")


def _marks(lines: DataFrame) -> DataFrame:
    """``(id, n, w0, w1, ...)`` of ``lines(id, coded)``: the number of shingles, repeated ones too, and the words of the mark."""
    last = f"octet_length(coded) - {2 * Q - 1}"
    cut = lines.select("id", F.expr(f"octet_length(coded) div 2 - {Q - 1}").alias("n"), "coded", F.expr(last).alias("last"), F.explode(F.expr(f"sequence(1, {last}, {2 * STRIDE})")).alias("i"))
    hashed = cut.select("id", "n", *[F.expr(f"xxhash64(substring(coded, least(i + {2 * j}, last), {2 * Q}))").alias(f"x{j}") for j in range(STRIDE)])
    placed = hashed.select("id", "n", *[F.expr(e).alias(f"{c}{j}") for j in range(STRIDE) for c, e in (("at", f"cast(shiftright(x{j}, 6) & {MARK // 64 - 1} as int)"), ("bit", f"shiftleft(1L, cast(x{j} & 63 as int))"))])
    return placed.groupBy("id", "n").agg(*[F.expr("bit_or(" + " | ".join(f"if(at{j} = {w}, bit{j}, 0L)" for j in range(STRIDE)) + ")").alias(f"w{w}") for w in range(MARK // 64)])


def _may(a: str, b: str, threshold: float) -> str:
    """Whether the lines of two marks may be near, with the fields of a mark written into ``a`` and ``b``.

    A bit that one mark has alone is that of a shingle which one set has alone, and near sets differ in ``(1 - t) / (1 + t)`` of the
    sum of their sizes at most.  So no near pair is left out.
    """
    apart = " + ".join(f"bit_count({a.format(f'w{j}')} ^ {b.format(f'w{j}')})" for j in range(MARK // 64))
    return f"{apart} <= {(1 - threshold) / (1 + threshold)} * ({a.format('n')} + {b.format('n')}) + 1e-9"


def _sure(a: str, b: str, low_a: str, low_b: str, threshold: float) -> str:
    """Whether two coded lines are surely near, as they differ in one short stretch; ``low_a``, ``low_b``: least numbers of their distinct shingles.

    Shingles inside the common start or end are in both sets, so each set has at most as many others as it has positions outside.
    The lengths are found by halving, up to 131071 characters; a shorter one than the true only proves less.
    """
    steps = f"array({', '.join(str(1 << k) for k in range(16, -1, -1))})"
    start = f"aggregate({steps}, 0, (p, k) -> if(p + k <= most and substring({a}, 2 * p + 1, 2 * k) = substring({b}, 2 * p + 1, 2 * k), p + k, p))"
    end = f"""aggregate({steps}, 0, (p, k) -> if(start + p + k <= most
        and substring({a}, octet_length({a}) - 2 * (p + k) + 1, 2 * k) = substring({b}, octet_length({b}) - 2 * (p + k) + 1, 2 * k), p + k, p))"""
    apart = [f"octet_length({x}) div 2 - {Q - 1} - greatest(start - {Q - 1}, 0) - greatest(end - {Q - 1}, 0)" for x in (a, b)]
    sure = f"x + y <= {1 / threshold - 1} * greatest({low_a} - x, {low_b} - y) - 1e-9"
    # variables of outer functions, each bound to a value once
    for name, value in (("y", apart[1]), ("x", apart[0]), ("end", end), ("start", start), ("most", f"cast(least(octet_length({a}), octet_length({b})) div 2 as int)")):
        sure = f"transform(array({value}), {name} -> {sure})[0]"
    return sure


def _bits(places: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """A bit map of ``n`` places ``(__row, pos)`` as broadcast ``(chunk, words)``, and the bit of a place in it.

    ``PLACE_BITS`` bits a place, fewer where that would exceed ``SMALL_BYTES``; then more other places pass.
    """
    chunks = max(1, min(-(-n * PLACE_BITS // (64 * CHUNK)), SMALL_BYTES // (8 * CHUNK)))
    bit = F.pmod(F.xxhash64("__row", "pos"), F.lit(chunks * CHUNK * 64))
    held = places.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("word"))
    words = places.sparkSession.range(chunks * CHUNK).join(held, "id", "left").select(F.expr(f"id div {CHUNK}").alias("chunk"), "id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return F.broadcast(words.groupBy("chunk").agg(F.expr("transform(sort_array(collect_list(struct(id, word))), w -> w.word)").alias("words"))), bit


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines of written ``wanted(id, __row, pos)``, each read at one place: ``(id, coded)``, in two-byte characters.

    Texts stay where they are: only lines whose place a bit map of the wanted ones lets through are shuffled.
    """
    chunks, bit = _bits(wanted, wanted.count())
    every = docs.select("__row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bit", bit).withColumn("chunk", F.expr(f"bit div {64 * CHUNK}"))
    passed = every.join(chunks, "chunk").where(f"shiftright(words[cast(bit div 64 % {CHUNK} as int)], cast(bit % 64 as int)) & 1 = 1").select("__row", "pos", "line")
    found = passed.join(wanted, ["__row", "pos"]).select("id", F.lower("line").alias("line"))
    return found.select("id", F.encode(_trim("line"), "UTF-16BE").alias("coded"))


def _verifier(lines: DataFrame, marks: DataFrame, scratch: Scratch, threshold: float):
    """Pairs whose shingle sets are near; ``lines(id, coded)`` holds the candidates and ``marks`` their marks and signatures."""

    def verify(pairs: DataFrame) -> DataFrame:
        one, other = ([F.col(c).alias(f"{c}_{e}" if c != "id" else e) for c in marks.columns] for e in "ab")
        low = [F.expr(" + ".join(f"bit_count(w{j}_{e})" for j in range(MARK // 64))).alias(f"low_{e}") for e in "ab"]
        # only marks and signatures travel until a pair may pass
        fit = pairs.join(marks.select(*one), "a").join(marks.select(*other), "b")
        fit = scratch.write(fit.where(_alike("{}_a", "{}_b")).where(_may("{}_a", "{}_b", threshold)).select("a", "b", *low), "pairs")
        used = only_used(lines, fit)
        sure = F.expr(_sure("l_a", "l_b", "low_a", "low_b", threshold))
        # whole lines travel, about a tenth of their sets; the sets are made where both lines are
        both = fit.join(used.toDF("a", "l_a"), "a").join(used.toDF("b", "l_b"), "b")
        both = both.select("a", "b", "l_a", "l_b", sure.alias("sure"))
        sets = both.select("a", "b", "sure", *[F.when(~F.col("sure"), _set(f"l_{e}")).alias(f"s_{e}") for e in "ab"])
        # a generator, as a filter would be pushed down and make the sets once more
        near = f"""filter(array(struct(a, b, size(array_intersect(s_a, s_b)) as common, size(s_a) + size(s_b) as n)),
            x -> sure or x.common >= {threshold} * (x.n - x.common) - 1e-9)"""
        return sets.select(F.inline(F.expr(near))).select("a", "b")

    return verify


def _large(classes: DataFrame, lines: DataFrame, marks: DataFrame, scratch: Scratch, threshold: float):
    """Links of large buckets for ``components.link``, compared inside the row of a pair of slabs.

    With B the set of the bucket's first line, a member is held as ``minus`` (B without it) and ``plus`` (it without B):
    two members have |B| - |minus u minus'| + |plus n plus'| shingles in common.  A pair is tested in the first bucket
    that it shares: ``early`` are a member's keys before this one.
    """

    def middle(left: DataFrame) -> DataFrame:
        """Buckets of up to ``MIDDLE`` members: pairs of members that are alike."""
        lanes = [c for c in marks.columns if c.startswith("s")]
        held = left.join(marks.select("id", *lanes), "id").groupBy("key").agg(F.collect_list(F.struct("id", "comp", *lanes)).alias("x"))
        likely = f"filter(x, q -> p.comp <> q.comp and p.id < q.id and {_alike('p.{}', 'q.{}')})"
        pairs = F.expr(f"flatten(transform(x, p -> transform({likely}, q -> named_struct('a', p.id, 'b', q.id))))")
        return _verifier(lines, marks, scratch, threshold)(held.select(F.inline(pairs)).distinct())

    def split(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Large buckets -> memberships of small buckets inside them, and those members for which that is not enough.

        Unrelated lines share a bucket by their most frequent shingles.  Of two lines with ``ENOUGH`` values in common, the rarest
        values of each, all but ``ENOUGH - 1``, meet (the prefix filter, any order of the values that is the same for both): members
        that share one of those form a small bucket.  A value that more than ``MIDDLE`` members of the bucket have makes no rows:
        who would meet others by it stays in the large bucket.
        """
        values = F.array(*[F.xxhash64(F.lit(i), f"m{i}") for i in range(VALUES)])
        held = scratch.write(left.join(narrow(classes, left.select("id").distinct(), ["id"], 16).select("id", values.alias("k")), "id").select("key", "id", "comp", "parts", "k"), "held")
        often = held.select("key", "comp", F.explode("k").alias("x")).groupBy("key", "x").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        often = scratch.write(often.where("c > 1").select("key", "x", "c", F.expr("low < high").alias("mixed")), "often")
        met = held.select("key", "id", "comp", "parts", F.explode("k").alias("x")).join(often, ["key", "x"], "left")
        ranked = met.groupBy("key", "id").agg(*[F.first(c).alias(c) for c in ("comp", "parts")], F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "x", F.coalesce("mixed", F.lit(False)).alias("mixed")))).alias("x"))
        rare = f"slice(x, 1, {VALUES - ENOUGH + 1})"
        rows = ranked.select("key", "id", "comp", "parts", F.expr(f"filter({rare}, z -> z.mixed)").alias("rare"))
        rows = rows.select("key", "id", "comp", "parts", F.expr(f"transform(filter(rare, z -> z.c <= {MIDDLE}), z -> z.x)").alias("few"), F.expr(f"exists(rare, z -> z.c > {MIDDLE})").alias("many"))
        rows = scratch.write(rows.where("many or size(few) > 0"), "rare")
        scratch.drop(held)
        scratch.drop(often)
        met = rows.select("key", "id", "comp", F.explode("few").alias("x")).groupBy("key", "x").agg(F.collect_list(F.struct("id", "comp")).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        found = met.where("low < high").select(F.xxhash64("key", "x").alias("key"), F.inline("m"))
        return found, rows.where("many").select("key", "id", "comp", "parts")

    def large(left: DataFrame) -> DataFrame:
        many = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MIDDLE).select("key")
        many = small(scratch.write(many, "many"), 24)
        found, rest = split(left.join(many, "key", "left_semi"))
        few = scratch.write(middle(left.join(many, "key", "left_anti").select("key", "id", "comp").union(found)), "edges")
        rest = scratch.write(rest, "rest")
        return few.union(hot(rest)) if rest.limit(1).count() else few

    def hot(left: DataFrame) -> DataFrame:
        ids = scratch.write(left.select("id").distinct(), "ids")
        whole = narrow(lines, ids, ["id"]).join(narrow(classes, ids, ["id"]).select("id", _keys().alias("keys")), "id")
        whole = scratch.write(whole, "whole")
        heads = left.groupBy("key").agg(F.min("id").alias("head"))
        heads = heads.join(whole.select(F.col("id").alias("head"), F.col("coded").alias("base")), "head").select("key", "base")
        full = left.join(whole, "id").join(small(heads, 4096), "key").select("key", "id", "comp", "parts", F.expr("slice(keys, 1, cast(array_position(keys, key) as int) - 1)").alias("early"), _set("coded").alias("s"), _set("base").alias("b"))
        full = full.select("key", "id", "comp", "parts", "early", F.size("s").alias("n"), F.size("b").alias("nb"), F.array_except("b", "s").alias("minus"), F.array_except("s", "b").alias("plus"))
        full = full.withColumns({"sm": F.size("minus"), "sp": F.size("plus")})
        told = scratch.write(full, "placed")
        scratch.drop(whole)
        placed = told.withColumn("w", F.expr(f"1 + (sm + sp) div {SHINGLES}"))
        slabs = tiled(placed, "w", SLAB).groupBy("key", "slab").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.first("nb").alias("nb"), F.collect_list(F.struct("id", "comp", "n", "sm", "sp", "early", "minus", "plus")).alias("x"))
        slabs = scratch.write(slabs, "slabs")
        scratch.drop(told)
        pairs = scratch.write(slab_pairs(slabs), "met")
        held = slabs.agg(F.avg(F.expr("aggregate(x, 0L, (t, m) -> t + 80 + 8 * (m.sm + m.sp + size(m.early)))")).alias("bytes")).first().bytes or 0
        rounds = max(1, -(-2 * pairs.count() * int(held) // ROUND))
        found = [scratch.write(compared(slabs, pairs.where(F.pmod(F.xxhash64("key", "slab", "other"), F.lit(rounds)) == i)), "found") for i in range(rounds)]
        scratch.drop(slabs)
        return functools.reduce(DataFrame.union, found)

    def compared(slabs: DataFrame, pairs: DataFrame) -> DataFrame:
        met = pairs.join(slabs.select("key", "slab", "nb", "x"), ["key", "slab"]).join(slabs.select("key", F.col("slab").alias("other"), F.col("x").alias("y")), ["key", "other"])
        need = f"{threshold / (1 + threshold)} * (p.n + q.n) - 1e-9"
        near = f"""filter(y, q -> p.comp <> q.comp and (slab < other or p.id < q.id)
            and nb - greatest(p.sm, q.sm) + least(p.sp, q.sp) >= {need}
            and not arrays_overlap(p.early, q.early)
            and nb - p.sm - q.sm + size(array_intersect(p.minus, q.minus)) + size(array_intersect(p.plus, q.plus)) >= {need})"""
        # of a line's links with one other component the first is enough
        once = f"""transform(array(transform({near}, q -> struct(q.comp as c, q.id as b))),
            z -> filter(z, (q, i) -> array_position(transform(z, w -> w.c), q.c) = i + 1))[0]"""
        links = F.expr(f"flatten(transform(x, p -> transform({once}, q -> named_struct('a', least(p.id, q.b), 'b', greatest(p.id, q.b)))))")
        return met.select(F.explode(links).alias("p")).select("p.a", "p.b")

    return large


def _own(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Written ``(__row, pos, h1, h2)``, a row a line."""
    return scratch.write(lines_of(docs).select("__row", "pos", *_hashes()), "own")


def _groups(docs: DataFrame, own: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Written ``(h1, h2, comp)`` for each distinct line that is near another; all other tables are freed."""
    outer, scratch = scratch, Scratch(scratch.spark, "near")
    classes = scratch.write(signed(docs).withColumn("id", F.monotonically_increasing_id()), "classes")
    shared = share(_members, classes, scratch)
    for pick in (lambda: shared, lambda: _pruned(shared, classes, scratch)):
        before, shared = shared, pick()
        every, classes = classes, scratch.write(classes.join(shared.select("id").distinct(), "id", "left_semi"), "classes")
        scratch.drop(every)
    scratch.drop(before)
    wanted = own.join(classes.select("id", "h1", "h2"), ["h1", "h2"]).groupBy("id").agg(F.min(F.struct("__row", "pos")).alias("at")).select("id", "at.__row", "at.pos")
    wanted = scratch.write(wanted, "wanted")
    lines = scratch.write(_texts(docs, wanted), "lines")
    scratch.drop(wanted)
    marks = scratch.write(_marks(lines).join(classes.select("id", *_lanes()), "id"), "marks")
    comp = link(shared, _verifier(lines, marks, scratch, threshold), _large(classes, lines, marks, scratch, threshold), scratch)
    near = outer.write(classes.select("id", "h1", "h2").join(comp, "id").select("h1", "h2", "comp"), "near")
    scratch.close()
    return near


def line_groups(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``(h1, h2, comp, keep_doc)`` for each distinct line that is near another: its component and the document (its ``__row``) that keeps a line of it."""
    docs = docs if "__row" in docs.columns else with_rows(docs, scratch)
    own = _own(docs.select("__row", "text"), scratch)
    near = _groups(docs.select("__row", "text"), own, scratch, threshold)
    first = own.join(near, ["h1", "h2"]).groupBy("comp").agg(F.min("__row").alias("keep_doc"))
    return near.join(first, "comp").select("h1", "h2", "comp", "keep_doc")


def line_dedup(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``text`` rid of lines that stay elsewhere, and ``line_dedup``, a struct of what happened.

    ``line_dedup`` has ``n_lines`` (blank ones not counted) and ``dropped``, the positions removed.
    """
    docs = with_rows(docs, scratch)
    texts = docs.select("__row", "text")
    own = _own(texts, scratch)
    near = _groups(texts, own, scratch, threshold)
    # lines that occur once and are near no other never leave their document: only the rest is regrouped
    counted = own.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("__row", "pos")).alias("at"))
    judged = counted.join(near, ["h1", "h2"], "left").where("n > 1 or comp is not null")
    judged = scratch.write(judged.select("h1", "h2", "at", F.col("comp")), "judged")
    first = judged.where("comp is not null").groupBy("comp").agg(F.min("at").alias("best"))
    judged = judged.join(first, "comp", "left").select("h1", "h2", F.coalesce("best", "at").alias("keep"))
    gone = own.join(judged, ["h1", "h2"]).where("__row <> keep.__row or pos <> keep.pos")
    gone = scratch.write(gone.groupBy("__row").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")
    held = gone.agg((F.count("*") * 40 + F.coalesce(F.sum(F.size("gone")), F.lit(0)) * 4).alias("bytes")).first().bytes
    return cut(docs.join(F.broadcast(gone) if held <= SMALL_BYTES else gone, "__row", "left")).drop("gone", "__row")


def cut(marked: DataFrame) -> DataFrame:
    """Apply the positions in ``gone`` to ``text``; tell them in ``line_dedup``."""
    drop = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.expr("filter(split(text, '\\n'), (x, i) -> not array_contains(gone, i))")
    told = F.struct(
        F.expr("size(filter(split(text, '\\n'), x -> trim(both ' \\t\\r' from x) <> ''))").alias("n_lines"),
        drop.alias("dropped"),
    )
    return marked.withColumn("line_dedup", told).withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
