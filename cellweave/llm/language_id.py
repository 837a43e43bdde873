"""Language identification by nearest centroid.

A text becomes counts of hashed character n-grams (one to three letters, lower case, runs of anything
but letters as one space), damped by a logarithm, weighted by inverse document frequency and scaled to unit length.
Each language has several centroids from spherical k-means, for its different kinds of text.
The language of the centroid of the highest cosine is predicted; a text further from it than nearly all
that it was built from is marked as rejected.

Document frequencies cover all learning rows; the centroids come from at most ``SAMPLE`` texts a language
(a documented bound), by seeded hash; a task a language clusters them.  The state of a model is ``DIM`` frequencies and
a few centroids a language, 32 KB each.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows of a null lang are not
learned from; without any learning row all is ``und``.  Repeated rows are predicted each; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.components import narrow
from cellweave.llm.training import by_row, fold

BITS = 13
DIM = 1 << BITS
SAMPLE = 600
CENTROIDS = 4
UNKNOWN = "und"
REJECT_QUANTILE = 0.001
SLICE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's hashed n-grams; None if it has no letter.  Long texts are counted in slices."""
    total = None
    text = (text or "").lower()
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = _letters()[code]
        if not is_letter.any():
            continue
        code = np.where(is_letter, code, 32).astype(np.uint32)
        space = ~is_letter
        code = code[~(space & np.concatenate(([False], space[:-1])))]
        one = code * np.uint32(2654435761)
        two = (one[:-1] ^ (code[1:] * np.uint32(40503))) * np.uint32(2246822519)
        three = (two[:-1] ^ (code[2:] * np.uint32(668265263))) * np.uint32(3266489917) if len(code) > 2 else np.empty(0, np.uint32)
        grams = np.concatenate([one, two, three]) >> np.uint32(32 - BITS)
        found = np.bincount(grams, minlength=DIM)
        total = found if total is None else total + found
    return total


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, c: np.ndarray | None) -> tuple[str, float, bool]:
        if c is None or not len(self.langs):
            return UNKNOWN, 0.0, True
        nz = np.flatnonzero(c)
        x = (1 + np.log(c[nz])) * self.idf[nz]
        norm = float(np.sqrt((x**2).sum())) or 1.0
        cosine = self.centroids[:, nz] @ (x / norm).astype(np.float32)
        best = int(cosine.argmax())
        return self.langs[self.owner[best]], float(np.clip(cosine[best], 0, 1)), bool(cosine[best] < self.least[best])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-point seeds."""
    rng = np.random.default_rng(seed)
    centre = [x.mean(axis=0)]
    centre[0] /= np.linalg.norm(centre[0]) or 1.0
    near = x @ centre[0]
    while len(centre) < min(k, len(x)):
        weight = np.maximum(1 - near, 1e-9)
        pick = x[rng.choice(len(x), p=weight / weight.sum())]
        centre.append(pick)
        near = np.maximum(near, x @ pick)
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
                c[i] /= np.linalg.norm(c[i]) or 1.0
    return c, (x @ c.T).argmax(axis=1)


def fit(docs: DataFrame, folds: int, held: int, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Document frequencies over all learning rows, centroids from a bounded sample of each language."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIM + 1, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                c = counts(t)
                if c is not None:
                    df[:DIM] += c > 0
                    df[DIM] += 1
        yield pd.DataFrame({"gram": np.arange(DIM + 1), "n": df})

    total = learn.select("text").mapInPandas(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[total["gram"].to_numpy(np.int64)] = total["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 0.1

    sizes = learn.groupBy("lang").agg(F.count("*").alias("n"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    thin = learn.select("doc_id", "lang").join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "lang").where(unit <= F.lit(2.0 * sample) / F.col("n") + 1e-3)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    drawn = thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", F.col("lang").alias("y")).dropDuplicates(["doc_id"])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, y, t in zip(pdf["doc_id"], pdf["y"], pdf["text"], strict=True):
                c = counts(t)
                if c is not None:
                    x = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
                    rows.append((i, y, (x / (np.linalg.norm(x) or 1.0)).astype(np.float16).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "x"])

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "x"])
        x = np.array([np.frombuffer(b, np.float16) for b in pdf["x"]], np.float32)
        c, own = _kmeans(x, centroids, seed=zlib.crc32(pdf["y"].iloc[0].encode("utf-8", "surrogatepass")))
        least = [float(np.quantile(x[own == j] @ c[j], REJECT_QUANTILE)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"y": pdf["y"].iloc[0], "least": least, "c": [v.astype(np.float32).tobytes() for v in c]})

    made = by_row(narrow(learn.select("doc_id", "text"), drawn, ["doc_id"], 64), vectors, "y string, x binary", "y", "text")
    # a language is clustered in a task of its own, so the driver holds only centroids
    got = sorted(made.groupBy("y").applyInPandas(clustered, "y string, least double, c binary").collect(), key=lambda r: r.y)
    langs = sorted({r.y for r in got})
    at = {y: i for i, y in enumerate(langs)}
    rows = np.array([np.frombuffer(r.c, np.float32) for r in got], np.float32).reshape(-1, DIM)
    return Model(idf, langs, rows, np.array([at[r.y] for r in got], int), np.array([r.least for r in got]))


def language_id(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, a row a document; ``rejected`` tells texts far from every centroid."""
    model = fit(docs, folds, held, sample, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.predict(counts(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got], rejected=[g[2] for g in got])

    rows = docs.select("doc_id", F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out"), "text")
    return by_row(rows, run, "held_out boolean, lang_pred string, score double, rejected boolean", "held_out", "text")
