"""Quality classification from positive and unlabelled texts.

Trusted positives are rows labelled 1; the unlabelled set is web text that no label is known of.  With class
prior p the risk of a scorer g is  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]):  the unbiased
risk of the negatives, which only unlabelled and positive texts enter, kept from going below zero.
Where a minibatch makes it negative, the step goes up that part instead, as the non-negative estimator asks.

The class prior is estimated from positives and unlabelled rows alone: the smallest ratio of the unlabelled to the
positive share above any score of a first scorer (fitted with a prior of a half on one half of the sample, read on the other).
Labels 0 are known negatives; they take no part.  Where every learning row has a label there is no unlabelled
set: then the labelled rows, 1 and 0 alike and without their labels, stand in for it.

A text is described by how it is written, not by its topic: shares of capitals, digits, symbols, white space and
marks, word and line lengths, repeated words and word triples, stop-like short words.  Each measure
is cut at quantiles of the sample into soft steps (so a linear score can bend); there is no vocabulary.

At most ``SAMPLE`` positives and as many unlabelled rows are drawn, by seeded hash (a documented bound).

Nulls: a null text is an empty text and is scored; null labels count as unlabelled; without a
positive every score is 0.5.  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.training import by_row, draw, fit_apart, fold, labelled, with_text

SAMPLE = 8_000
STEPS = 8
EPOCHS = 40
LEAST_STEPS = 600
_TRIPLE = 3
_RUN = re.compile(r"[^\w\s]{2,}")
_LONG = re.compile(r"\w{25,}")
NAMES = ["size", "upper", "digit", "mark", "space", "pipe", "shout", "odd", "runs", "word", "line", "short", "distinct", "adjacent", "triples", "lines_again", "ends", "capital_words", "other", "long_words"]
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = "#$%&*+/<=>@\\^_`{|}~"


def _kinds() -> dict[int, str]:
    """ASCII to one letter a kind, to count kinds with str.count."""
    out = {}
    for c in range(128):
        ch = chr(c)
        out[c] = "U" if ch.isupper() else "L" if ch.islower() else "D" if ch.isdigit() else "S" if ch.isspace() else ch
    return out


_KINDS = bytes(ord(_kinds()[c]) if c < 128 else 0x4F for c in range(256))


def describe(text: str | None) -> list[float]:
    """The measures of a whole text, in the order of ``NAMES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    count = np.bincount(np.frombuffer(raw.translate(_KINDS), np.uint8), minlength=128)
    words, lines = text.split(), text.split("\n")
    w = len(words) or 1
    distinct = len(set(words))
    adjacent = sum(map(str.__eq__, words, words[1:]))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    t = len(triples)
    full = [x for x in lines if x]
    upper = int(count[ord("U")])
    letters = upper + int(count[ord("L")]) + int(count[ord("O")]) or 1
    marks = sum(int(count[ord(c)]) for c in _MARKS)
    odd = sum(int(count[ord(c)]) for c in _ODD)
    return [
        np.log1p(w),
        upper / letters,
        int(count[ord("D")]) / n,
        marks / n,
        int(count[ord("S")]) / n,
        int(count[ord("|")]) / w,
        int(count[ord("!")]) / w,
        odd / n,
        len(_RUN.findall(text)) / w,
        len(text) / w,
        w / (len(full) or 1),
        sum(len(x) <= 3 for x in words) / w,
        distinct / w**0.85,
        adjacent / w,
        1 - len(set(triples)) / t if t else 0.0,
        1 - len(set(full)) / (len(full) or 1),
        sum(x[-1] in ".!?:;\"'" for x in full) / (len(full) or 1),
        sum(x.isupper() for x in words) / w,
        int(count[ord("O")]) / n,
        len(_LONG.findall(text)) / w,
    ]


@dataclass
class Scorer:
    """A linear score over soft steps of each measure."""

    cuts: np.ndarray
    width: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x[:, :, None] - self.cuts[None]) / self.width[None], -30, 30)
        return (1 / (1 + np.exp(-z))).reshape(len(x), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weight + self.bias, -30, 30)))


def envelope_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The smallest ratio of the unlabelled to the positive share above any score that a fifth of the positives exceed.

    The unlabelled are p positives and 1 - p negatives, so the ratio is p plus the negatives above the score: p where
    none are.  A standard error of the unlabelled share is added, as the smallest of many ratios falls below its mean.
    """
    cut = np.quantile(pos, np.linspace(0.0, 0.8, 33))
    above = np.array([(unl >= c).mean() for c in cut])
    ratio = (above + np.sqrt(above * (1 - above) / len(unl)) + 1 / len(unl)) / np.maximum([(pos >= c).mean() for c in cut], 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 5, epochs: int = EPOCHS, rate: float = 0.03, decay: float = 1e-4) -> Scorer:
    """Minimise the non-negative risk with the logistic loss by minibatch Adam."""
    if not len(pos) or not len(unl):
        return Scorer(np.zeros((len(NAMES), STEPS)), np.ones((len(NAMES), STEPS)), np.zeros(0), 0.0, 0.5)
    both = np.concatenate([pos, unl])
    cuts = np.quantile(both, np.r_[np.linspace(0.05, 0.95, STEPS - 3), 0.98, 0.995, 0.01], axis=0).T
    spread = np.quantile(both, 0.9, axis=0) - np.quantile(both, 0.1, axis=0)
    width = np.repeat(np.maximum(spread / 10, np.maximum(both.std(axis=0) / 10, 1e-6))[:, None], STEPS, axis=1)
    model = Scorer(cuts, width, np.zeros(0), 0.0, 0.0)
    if prior is None:
        model.prior = 0.5
        if min(len(pos), len(unl)) >= 4:  # the halves keep the estimate clear of what the scorer has seen
            first = fit(pos[::2], unl[::2], 0.5, seed, 6)
            prior = envelope_prior(first.score(pos[1::2]), first.score(unl[1::2]))
        else:
            prior = 0.5
    xp, xu = model.expand(pos), model.expand(unl)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, s, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    parts = max(1, max(len(xp), len(xu)) // 512)
    epochs = max(epochs, -(-LEAST_STEPS // parts)) if epochs >= EPOCHS else epochs  # small samples get enough steps too
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
        for ip, iu in zip(np.array_split(order_p, parts), np.array_split(order_u, parts), strict=True):
            if not len(ip) or not len(iu):
                continue
            a, u = xp[ip], xu[iu]
            sp, su = 1 / (1 + np.exp(-np.clip(a @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            gn = np.append(u.T @ su / len(u) - prior * (a.T @ sp) / len(a), su.mean() - prior * sp.mean())
            gp = np.append(a.T @ (sp - 1) / len(a), (sp - 1).mean()) * prior
            g = gp + gn if negative >= 0 else -gn
            g[:-1] += decay * w
            step += 1
            m += 0.1 * (g - m)
            s += 0.001 * (g**2 - s)
            d = rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            w -= d[:-1]
            b -= d[-1]
    model.weight, model.bias, model.prior = w, float(b), float(prior)
    return model


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [np.array(describe(t)).tobytes() for t in pdf["text"]]})


def _train(got: pd.DataFrame | None) -> bytes:
    if got is None:
        return pickle.dumps(fit(np.zeros((0, len(NAMES))), np.zeros((0, len(NAMES))), None))
    got = got.sort_values(["y", "doc_id", "x"])
    x = np.array([np.frombuffer(b) for b in got["x"]], np.float64).reshape(-1, len(NAMES))
    y = got["y"].to_numpy()
    return pickle.dumps(fit(x[y == 1], x[y == 2], None))


def fit_on(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int = SAMPLE) -> Scorer:
    """Draw positives and unlabelled rows outside the held-out fold, estimate the prior, and fit, in one task on an executor."""
    known = labelled(labels, label, folds, held)
    positive = draw(known.where("y = 1").select("doc_id", "y"), sample, seed=11)
    free = docs.where(F.col("doc_id").isNotNull() & (fold(folds) != held)).select("doc_id").join(labels.where(F.col(label).isNotNull()).select("doc_id"), "doc_id", "left_anti")
    free = free.distinct() if free.limit(1).count() else known.select("doc_id")
    chosen = with_text(docs, positive.union(draw(free, sample, seed=13).withColumn("y", F.lit(2))))
    return pickle.loads(fit_apart(by_row(chosen, _described, "y int, x binary", "y", "text").select("doc_id", "y", "x"), _train))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row a document."""
    model = fit_on(docs, labels, label, folds, held, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([describe(t) for t in pdf["text"]], np.float64).reshape(-1, len(NAMES))
            yield pdf[["doc_id", "held_out"]].assign(score=model.score(x))

    rows = docs.select("doc_id", F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out"), "text")
    scored = by_row(rows, run, "held_out boolean, score double", "held_out", "text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold; scored where they are, without a join."""
    model = fit_on(docs, labels, label, folds, held, sample)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([describe(t) for t in texts], np.float64).reshape(-1, len(NAMES))))

    return docs.where(score("text") >= threshold)
