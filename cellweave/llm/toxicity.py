"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words in lower case and their first four to six letters, so that inflected insults share a
term; each counts once.  A term's hash is its feature.  The machine has a bias, a weight a feature, and a short
vector a feature whose products give each pair of terms a weight of its own: an insult next to a
group's name can weigh more than the sum of both, which no additive model can learn.

Fitting: at most ``SAMPLE`` labelled rows (a documented bound) outside the held-out fold, by seeded hash.
Features in fewer than ``MIN_DF`` sample texts, or without any association with the label, are left out;
minibatch Adam with a proximal step for the weights (sparse) and decay for the vectors.  One task on an executor fits;
the model is a few thousand numbers; scoring is one map over the whole texts.

Nulls: a null or empty text has no terms, its score is the bias alone; null labels are not learned from.
Without labelled rows every score is 0.1.  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.training import by_row, draw, fit_apart, fold, labelled, with_text

SPACE = 1 << 22
SAMPLE = 16_000
MIN_DF = 4
RANK = 4
EPOCHS = 14
LEAST_STEPS = 250
LEAST_Z = 2.0
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[int, ...]:
    """The features of a word in lower case: itself and its beginnings."""
    out = [zlib.crc32(word.encode()) % SPACE]
    for n in (4, 5, 6):
        if len(word) >= n:
            out.append(zlib.crc32(b"^" + word[:n].encode()) % SPACE)
    return tuple(out)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """A fitted factorization machine; ``index`` maps a feature to its row."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    index: dict[int, int]

    def margins(self, rows: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Margins of ``n`` texts; ``rows`` are the active rows of text after text, ``starts`` where each begins."""
        return self.bias + _parts(self.weight, self.vectors, rows, np.repeat(np.arange(n), np.diff(np.append(starts, len(rows)))), n)[0]


def _parts(w: np.ndarray, v: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    linear = np.bincount(owner, w[rows], n)
    sums = np.stack([np.bincount(owner, v[rows, k], n) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(owner, (v**2).sum(axis=1)[rows], n)
    return linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fit(samples: list[np.ndarray], y: np.ndarray, seed: int = 7, rank: int = RANK, epochs: int = EPOCHS, min_df: int = MIN_DF, rate: float = 0.05, l1: float = 1e-3, decay: float = 1e-3) -> Machine:
    """Fit on each text's distinct features and its 0/1 label."""
    if not len(samples) or len(set(y.tolist())) < 2:
        base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.1
        return Machine(float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, rank)), {})
    flat, sizes = np.concatenate(samples).astype(np.int64), np.array([len(s) for s in samples])
    df = np.bincount(flat, minlength=SPACE)
    hits = np.bincount(flat, np.repeat(y, sizes), SPACE)
    p = y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(hits - df * p) / np.sqrt(df * p * (1 - p))
    used = np.flatnonzero((df >= min_df) & (z >= LEAST_Z))
    column = np.full(SPACE, -1, np.int32)
    column[used] = np.arange(len(used))
    rows_all = column[flat]
    keep = rows_all >= 0
    owner_all = np.repeat(np.arange(len(samples)), sizes)[keep]
    rows_all = rows_all[keep]
    starts = np.searchsorted(owner_all, np.arange(len(samples) + 1))
    rng = np.random.default_rng(seed)
    f = len(used)
    w, v, bias = np.zeros(f), rng.normal(0, 0.01, (f, rank)), float(np.log(p / (1 - p)))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    step, batch = 0, 512
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(samples)))  # small samples get enough steps too
    for epoch in range(epochs):
        lr = rate * (1 - epoch / (epochs + 1))
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            n = len(chosen)
            size = starts[chosen + 1] - starts[chosen]
            owner = np.repeat(np.arange(n), size)
            rows = rows_all[np.repeat(starts[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            margin, sums = _parts(w, v, rows, owner, n)
            g = (1 / (1 + np.exp(-np.clip(margin + bias, -30, 30))) - y[chosen]) / n
            gw = np.bincount(rows, g[owner], f)
            gv = np.stack([np.bincount(rows, g[owner] * (sums[owner, k] - v[rows, k]), f) for k in range(rank)], axis=1) + decay * v / n
            step += 1
            for i, (param, grad) in enumerate(((w, gw), (v, gv))):
                m, s = state[2 * i], state[2 * i + 1]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                param -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            bias -= 0.1 * lr * g.sum() * 10
            np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - lr * l1 * 10, 0))
    live = (np.abs(w) > 1e-3) | (np.sqrt((v**2).sum(axis=1)) > 0.02)
    return Machine(bias, w[live], v[live], {int(c): i for i, c in enumerate(used[live])})


def fit_on(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int = SAMPLE) -> Machine:
    """Draw the bounded sample, turn it into features on the executors, and fit."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [np.fromiter({f for w in words_of(t) for f in features_of(w)}, np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "f": got})

    def train(got: pd.DataFrame | None) -> bytes:
        if got is None or not len(got):
            return pickle.dumps(fit([], np.zeros(0)))
        got = got.sort_values(["doc_id", "f"])
        return pickle.dumps(fit([np.frombuffer(f, np.int32) for f in got["f"]], got["y"].to_numpy(np.float64)))

    chosen = draw(labelled(labels, label, folds, held), sample, seed=3)
    return pickle.loads(fit_apart(by_row(with_text(docs, chosen), hashed, "y int, f binary", "y", "text").select("doc_id", "y", "f"), train))


def scorer(machine: Machine):
    """A batch function that adds ``score`` to ``(doc_id, held_out, text)``."""

    class Rows(dict):
        def __missing__(self, word: str) -> tuple[int, ...]:
            found = tuple(r for f in features_of(word) if (r := machine.index.get(f)) is not None)
            if len(self) < 300_000 and len(word) <= 40:
                self[word] = found
            return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_of = Rows()
        for pdf in batches:
            active = [{r for w in words_of(t) for r in rows_of[w]} for t in pdf["text"]]
            sizes = np.array([len(a) for a in active], np.int64)
            flat = np.fromiter((r for a in active for r in sorted(a)), np.int64, int(sizes.sum()))
            margin = machine.margins(flat, np.cumsum(sizes) - sizes, len(active))
            out = pdf[["doc_id", "held_out"]].assign(score=1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield out

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row a document."""
    machine = fit_on(docs, labels, label, folds, held, sample)
    rows = docs.select("doc_id", F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out"), "text")
    scored = by_row(rows, scorer(machine), "held_out boolean, score double", "held_out", "text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
