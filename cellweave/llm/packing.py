"""Best-fit packing of tokenised documents into sequences of equal capacity.

Bulk-synchronous best fit.  Documents longer than the capacity are cut into pieces of the capacity; the last
piece may be shorter.  A piece of over half the capacity opens a sequence of its own, as no two of them share one; the
free end of a sequence is a gap.  Then rounds place the other pieces:

1. Pieces and gaps are range-sorted together by size, largest first.  Each task holds one range and sweeps it: pieces from
   the longest on go to the successor of their length, the smallest gap there that is large enough, and what remains of
   that gap stays in the sweep.
2. What found no gap in its range takes the gaps that the ranges above have left.  Only counts meet, a row a range: ranked
   pieces and ranked gaps are dealt to each other so that no gap is asked for by more pieces than it surely holds.
3. Gaps shrink by what they took; gaps too small for every piece left are closed; and the next round begins.  If pieces
   were left without any gap, as many sequences are opened as their tokens fill.

A gap that takes pieces from below loses at least half its size, so rounds grow with the logarithm of the capacity, not
with the data.  When pieces and gaps fit one task (``ROWS``), a last sweep places all, opening sequences as it must.

Nulls: a null text has the end token alone; a null doc_id is kept.  Repeated rows are packed each.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.components import small
from cellweave.llm.training import by_row
from cellweave.storage import Scratch

CAPACITY = 2048
END_ID = 0
CACHE = 500_000
#: Pieces and gaps of a range, about; so many or fewer are packed by one task.
ROWS = 100_000


#: Letters that are their own NFC form and have one lower-case form, of the same range; and the marks of ASCII but the apostrophe, which may join to letters.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters beyond ASCII as the tokenizer's byte level writes their UTF-8 bytes: C3 as itself, 80 to A0 from U+0122 on, AD as U+0143, others as themselves.
BYTES = {c: "\u00c3" + chr(0x122 + b - 0x80 if b <= 0xA0 else 0x143 if b == 0xAD else b) for c in range(0xC0, 0x100) for b in [0x80 + (c & 0x3F)]}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class WordTokens(dict):
    """Token ids of white-space-separated words as little-endian bytes, from a public tokenizer file.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in
    order.  The cache is bounded: when full, further words are encoded anew each time.  A run of Latin letters is one
    pre-token and the marks after it another; both are given to the model as they are, other words to the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or LATIN(word)):  # one pre-token
            low = word.lower()
            out = packed([t.id for t in self.model.tokenize(low if low.isascii() else low.translate(BYTES))])
        elif (letters := word.rstrip(MARKS)) != word and letters.isalpha():  # letters, then a run of marks: two pre-tokens
            return self[letters] + self[word[len(letters) :]]  # not kept, as its two parts are
        else:
            out = packed(self.whole.encode(word, add_special_tokens=False).ids)
        if len(self) < CACHE and len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """One tokenizer a process."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, text)`` -> a row a piece: ``doc_id, piece, start, length, ids_crc32`` and ``pid``, a number that it has alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = tokens(tokenizer)
        end = struct.pack("<I", END_ID)
        pid = TaskContext.get().partitionId() << 36
        step = 4 * capacity
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), pid))
                    pid += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "pid"])

    return by_row(docs, cut, "piece int, start long, length long, ids_crc32 long, pid long", "text")


class Gaps:
    """Open sequences by free size; the successor of a length is the lowest bit at or above it in a mask of the sizes there are."""

    def __init__(self):
        self.of: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, size: int, seq: int) -> None:
        if size:
            self.of.setdefault(size, []).append(seq)
            self.mask |= 1 << size

    def take(self, length: int) -> tuple[int, int] | None:
        """The size and number of a smallest gap of ``length`` or more."""
        above = self.mask >> length
        if not above:
            return None
        size = length + (above & -above).bit_length() - 1
        held = self.of[size]
        seq = held.pop()
        if not held:
            self.mask &= ~(1 << size)
        return size, seq

    def left(self) -> list[tuple[int, int]]:
        return [(size, seq) for size in sorted(self.of, reverse=True) for seq in self.of[size]]


def sweep(items: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int, opens: int | None = None) -> tuple[list, list, list]:
    """Best fit of ``items`` (length, pid), longest first, into ``gaps`` (size, seq).

    Returns the placed (pid, length, seq, offset), the items and the gaps left.  With ``opens``, a number from which new
    sequences count downwards, no item is left.
    """
    open_, placed, left = Gaps(), [], []
    for size, seq in gaps:
        open_.add(size, seq)
    for length, pid in items:
        found = open_.take(length)
        if found is None:
            if opens is None:
                left.append((length, pid))
                continue
            found, opens = (capacity, opens), opens - 1
        size, seq = found
        placed.append((pid, length, seq, capacity - size))
        open_.add(size - length, seq)
    return placed, left, open_.left()


PLACED, ITEM, GAP = 0, 1, 2
_STATE = "kind int, id long, size long, seq long, off long, part int, idx long"


def _swept(state: DataFrame, parts: int, capacity: int, opens: int | None) -> DataFrame:
    """One sweep of each range of ``state(kind, id, size)``: placed pieces, and pieces and gaps left, ranked in their range.

    A gap that is still as large as its range's pieces has a rank ``idx``; a smaller one has none until the next round.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [p for p in batches if len(p)]
        if not got:
            return
        pdf, part = pd.concat(got), TaskContext.get().partitionId()
        floor = int(pdf["size"].min())
        of = {k: list(zip(g["size"].tolist(), g["id"].tolist(), strict=True)) for k, g in pdf.sort_values(["size", "id"], ascending=[False, True]).groupby("kind")}
        placed, items, gaps = sweep(of.get(ITEM, []), of.get(GAP, []), capacity, opens)
        rows = [(PLACED, pid, length, seq, off, part, -1) for pid, length, seq, off in placed]
        rows += [(ITEM, pid, length, None, None, part, i) for i, (length, pid) in enumerate(items)]
        rows += [(GAP, seq, size, None, None, part, i if size >= floor else -1) for i, (size, seq) in enumerate(gaps)]
        for at in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[at : at + 10_000], columns=["kind", "id", "size", "seq", "off", "part", "idx"]).astype({"seq": "Int64", "off": "Int64"})

    # number and kind break ties, so a length that many rows share is dealt to several ranges; a gap stands before pieces of its size
    if parts > 1:
        dealt = state.repartitionByRange(parts, F.desc("size"), F.desc("kind"), F.asc("id"))
    else:
        dealt = state.coalesce(1)
    return dealt.select("kind", "id", "size").mapInPandas(run, _STATE)


def deal(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces left in ranges to gaps left in ranges above: ``(part, pieces, longest, gaps, smallest gap)`` in order of range.

    Returns ``(part, first piece, end, part of the gaps, first gap, pieces a gap)``: the nearest range above gives first, its
    smallest gaps first.
    """
    stack: list[list[int]] = []
    out = []
    for part, pieces_, longest, gaps, smallest in ranges:
        at = 0
        while at < pieces_ and stack:
            q, n, least = stack[-1]
            fit = least // longest
            if not fit:
                stack.pop()
                continue
            used = min(n, -(-(pieces_ - at) // fit))
            end = min(pieces_, at + used * fit)
            out.append((part, at, end, q, n - used, fit))
            at, stack[-1][1] = end, n - used
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps, smallest])
    return out


def _round(swept: DataFrame, capacity: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a sweep: pieces left take gaps left in the ranges above.  Returns what it placed, the pieces and the gaps that remain."""
    items, gaps = swept.where(F.col("kind") == ITEM), swept.where((F.col("kind") == GAP))
    told = swept.where("kind <> 0").groupBy("part").agg(
        F.count_if(F.col("kind") == ITEM).alias("pieces"), F.max(F.when(F.col("kind") == ITEM, F.col("size"))).alias("longest"),
        F.count_if((F.col("kind") == GAP) & (F.col("idx") >= 0)).alias("gaps"), F.min(F.when((F.col("kind") == GAP) & (F.col("idx") >= 0), F.col("size"))).alias("smallest"),
    )
    segments = deal(sorted((r.part, r.pieces, r.longest or 0, r.gaps, r.smallest or 0) for r in told.collect()))  # a row a range
    named = swept.sparkSession.createDataFrame(segments, "part int, first long, end long, q int, gap long, fit long")
    asked = items.join(small(named, 64), "part", "left").where("first is null or (idx >= first and idx < end)")
    asked = asked.select("id", "size", "idx", "q", (F.col("gap") + F.expr("(idx - first) div fit")).alias("g"))
    asked = scratch.write(asked, "asked")
    offered = gaps.where("idx >= 0").select(F.col("part").alias("q"), F.col("idx").alias("g"), F.col("id").alias("seq"), F.col("size").alias("room"))
    before = Window.partitionBy("q", "g").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # `fit` rows at most
    met = asked.where("q is not null").withColumn("used", F.coalesce(F.sum("size").over(before), F.lit(0))).join(offered, ["q", "g"])
    met = scratch.write(met.select("id", "size", "seq", (F.lit(capacity) - F.col("room") + F.col("used")).alias("off")), "met")
    taken = met.groupBy("seq").agg(F.sum("size").alias("taken"))
    shrunk = gaps.select(F.col("id").alias("seq"), "size").join(taken, "seq", "left").select(F.col("seq").alias("id"), (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size"))
    # a piece beyond its range's segments matched no row of the join: it waits
    waiting = items.select("id", "size").join(met.select("id"), "id", "left_anti")
    return met, waiting, shrunk


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = CAPACITY, rows: int = ROWS) -> DataFrame:
    """Documents -> their pieces with ``sequence_id`` and ``offset``."""
    cut = scratch.write(pieces(docs, tokenizer, capacity), "pieces")
    opener = F.col("length") * 2 > capacity
    done = [cut.where(opener).select(F.col("pid").alias("id"), F.col("pid").alias("seq"), F.lit(0).cast("long").alias("off"))]
    items = cut.where(~opener).select(F.lit(ITEM).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("size"))
    gaps = cut.where(opener & (F.col("length") < capacity)).select(F.lit(GAP).alias("kind"), F.col("pid").alias("id"), (capacity - F.col("length")).alias("size"))
    opens, state = -1, scratch.write(items.union(gaps), "state")
    while True:
        told = state.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == ITEM).alias("items"), F.min(F.when(F.col("kind") == ITEM, F.col("size"))).alias("least")).first()
        if not told["items"]:
            break
        last = told.n <= rows
        swept = scratch.write(_swept(state, 1 if last else -(-told.n // rows), capacity, opens if last else None), "swept")
        done.append(swept.where(F.col("kind") == PLACED).select("id", "seq", "off"))
        if last:
            break
        met, waiting, shrunk = _round(swept, capacity, scratch)
        done.append(met.select("id", "seq", "off"))
        waiting = scratch.write(waiting, "waiting")
        rest = waiting.agg(F.sum("size").alias("tokens"), F.min("size").alias("least"), F.max("size").alias("most")).first()
        if rest.tokens is None:
            break
        after = shrunk.where(F.col("size") >= rest.least).select(F.lit(GAP).alias("kind"), "id", "size")
        if not after.where(F.col("size") >= rest.most).limit(1).count():  # the longest piece left has no gap
            fresh = -(-rest.tokens // capacity)
            after = after.union(state.sparkSession.range(fresh).select(F.lit(GAP).alias("kind"), (opens - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size")))
            opens -= fresh
        old, state = state, scratch.write(waiting.select(F.lit(ITEM).alias("kind"), "id", "size").union(after), "state")
        scratch.drop(old)
    where = done[0]
    for d in done[1:]:
        where = where.union(d)
    placed = cut.join(where.toDF("pid", "sequence_id", "offset"), "pid")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
