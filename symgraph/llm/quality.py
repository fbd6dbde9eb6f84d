"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the logarithm of the ratio of their smoothed shares in good and bad documents; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent and mixed with the mean weight;
a logistic curve, fitted on rows set aside, turns its margin into a score. N-grams are of words, and of the words'
shapes (case, digits, marks, and whether a word repeats the one before it), which carry over to words never seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, per_batch, rows_of
from symgraph.llm.learning import Sparse, feature_rows, frequencies, hashed, held_out, sampled, scores, sigmoid

BITS = 20
#: Labelled documents learned from at most.
LABELLED = 8_000
#: Fewest documents of the sample that have a feature in use.
LEAST = 8
SHAPES = 1 << 9
REMEMBERED = 200_000
SPLIT = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def shape(token: str) -> str:
    """The token's case or kind with the first marks around it."""
    before, word, after = SPLIT.match(token).groups()
    if not word:
        kind = ""
    elif word.isalpha():
        kind = "u" if len(word) > 1 and word.isupper() else "t" if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else "l" if word.islower() else "m"
        kind += "+" * (len(word) > 20)
    else:
        kind = "d" if word.isdigit() else "x"
    return f"{before[:3]}{kind}{after[:3]}"


class Features(dict):
    """Features of texts. As a dictionary: token -> numbers of its shape and of its word in one, filled when first asked for."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[token] = hashed("s", shape(token), 8) << BITS | hashed("w", token.lower(), BITS)
        return out

    def of(self, text: str) -> np.ndarray:
        """Distinct feature numbers of a text: its words, and 1- to 3-grams of its words' shapes."""
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.int32)
        both = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        s = both >> BITS
        s[1:] += 256 * np.fromiter((a == b for a, b in zip(tokens, tokens[1:], strict=False)), np.int64, len(tokens) - 1)
        grams = [s, s[:-1] * SHAPES + s[1:] + SHAPES, (s[:-2] * SHAPES + s[1:-1]) * SHAPES + s[2:] + SHAPES * (SHAPES + 1)]
        mixed = np.concatenate(grams).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        return np.unique(np.concatenate([mixed.astype(np.int64), both & ((1 << BITS) - 1)])).astype(np.int32)


def descend(x: Sparse, y: np.ndarray, width: int, c: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent; labels are -1 and 1; rare ones weigh more."""
    ends = np.cumsum(x.lengths)
    begins = ends - x.lengths
    squares = np.maximum(np.bincount(x.at, x.values**2, x.n), 1e-12)
    few = np.array([c * len(y) / (2 * max(1, (y == k).sum())) for k in (-1, 1)])
    most = np.where(y > 0, few[1], few[0])
    w, alpha, order = np.zeros(width), np.zeros(x.n), np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(x.n):
            ids, values = x.ids[begins[i] : ends[i]], x.values[begins[i] : ends[i]]
            slope = y[i] * (w[ids] @ values) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), most[i])
            if new != alpha[i]:
                w[ids] += (new - alpha[i]) * y[i] * values
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve of the margins, by Newton steps; the slope is positive."""
    scale = max(float(np.abs(z).mean()), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    t = np.zeros(2)
    for _ in range(30):
        p = sigmoid(x @ t)
        t = t - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * t)
    return max(t[0], 1e-3) / scale, t[1]


def train(rows: list[np.ndarray], y: np.ndarray, mix: float = 0.5) -> dict:
    """The model: weight of each feature number, slope and place of the score. Too few rows or one class: a constant."""
    y = np.where(y > 0, 1, -1)
    if min((y > 0).sum(), (y < 0).sum()) < 5:
        return {"ids": np.zeros(0, np.int64), "weights": np.zeros(0), "slope": 1.0, "place": 1.0 if (y > 0).sum() >= (y < 0).sum() else -1.0}
    apart = np.arange(len(y)) % 5 == 0
    chosen = [r for r, a in zip(rows, apart, strict=True) if not a]
    yt = y[~apart]
    count = frequencies(chosen, 1 << BITS)
    kept = np.flatnonzero((count >= min(LEAST, max(2, len(chosen) // 50))) & (count < len(chosen)))
    good = frequencies([r for r, k in zip(chosen, yt, strict=True) if k > 0], 1 << BITS)[kept] + 1
    bad = frequencies([r for r, k in zip(chosen, yt, strict=True) if k < 0], 1 << BITS)[kept] + 1
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))

    def sparse(some: list[np.ndarray]) -> Sparse:
        ids = [np.concatenate([number[r][number[r] >= 0], [len(kept)]]) for r in some]
        r = np.append(ratio, 1.0)
        return Sparse(ids, [r[i] / max(np.sqrt((r[i] ** 2).sum()), 1e-9) for i in ids])

    w = descend(sparse(chosen), yt, len(kept) + 1)
    w[:-1] = (1 - mix) * np.abs(w[:-1]).mean() + mix * w[:-1]
    z = sparse([r for r, a in zip(rows, apart, strict=True) if a]).times(w)
    slope, place = calibrated(z, y[apart])
    return {"ids": kept, "ratio": ratio, "weights": w, "slope": slope, "place": place}


class Scorer:
    """Scores texts by a model."""

    def __init__(self, model: dict):
        self.model, self.features = model, Features().of
        self.number = np.full(1 << BITS, -1, np.int32)
        self.number[model["ids"]] = np.arange(len(model["ids"]))

    def score(self, text: str) -> float:
        m = self.model
        if not len(m["ids"]):
            return float(sigmoid(np.float64(m["place"])))
        ids = self.number[self.features(text)]
        ids = ids[ids >= 0]
        r = m["ratio"][ids]
        z = (m["weights"][ids] @ r + m["weights"][-1]) / np.sqrt((r**2).sum() + 1)
        return float(sigmoid(m["slope"] * z + m["place"]))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from at most LABELLED labels (doc_id, quality 0 or 1) of rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows, y = feature_rows(docs, sampled(known, LABELLED), lambda: Features().of)
    return train(rows, y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Texts are read whole; null ones are empty and have no features. Neither labels nor lang, source or doc_id enter a
    score. Repeated rows give repeated results; without labels of both kinds the score is a constant; an empty table
    gives an empty result.
    """
    model = fit(docs, labels)
    return scores(docs, lambda: Scorer(model).score, threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whole, whose score reaches the threshold; filtered in the scan, without a shuffle.

    Null and empty texts have the score of a text without features; repeated rows stay or go together; an empty table stays
    empty; long texts are read whole."""
    model = fit(docs, labels)

    def make():
        score = Scorer(model).score

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([score(t) >= threshold for _, t in rows_of(batch, "text")], pa.bool_()))

        return each

    return in_batches(docs).mapInArrow(per_batch(make), docs.schema)
