"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic documents and unlabelled text, in which a known share (the class prior) is toxic too.
The risk of calling toxic text clean is estimated on the former, that of calling clean text toxic as the latter's loss
less the share's part; where this difference falls below zero, which no true risk does, the step goes against it instead
of along it, which keeps the model from learning the sample by heart.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.learning import Sparse, feature_rows, frequencies, hashed, held_out, sampled, scores, sigmoid

BITS, PREFIXES = 20, (4, 5, 6, 7)
#: Documents learned from at most: confirmed toxic ones, and unlabelled ones.
POSITIVES, UNLABELLED = 3_000, 6_000
REMEMBERED = 400_000
EDGES = re.compile(r"^\W+|\W+$")


def word_features(token: str) -> list[int]:
    """Numbers of a token's word and of its beginnings."""
    word = EDGES.sub("", token)
    if not word:
        return []
    return [hashed("w", word, BITS)] + [hashed("p", word[:n], BITS) for n in PREFIXES if len(word) > n]


def features(text: str) -> np.ndarray:
    """Feature numbers of the text's distinct tokens; one that several tokens have is repeated."""
    return np.array([f for t in sorted(set(text.lower().split())) for f in word_features(t)], np.int32)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.1, shrink: float = 0.003, beta: float = 0.0, gamma: float = 1.0) -> dict[int, float]:
    """Weights by feature number, and the bias at -1.

    Features are kept that at least 3 toxic documents have, that toxic ones have 3 times as often as unlabelled text, and
    whose difference is 3 standard deviations; each step shrinks the weights by a little, so that those of chance end at
    zero and don't add up over a long text. Empty inputs give a model whose score is the prior.
    """
    bias = float(np.log(max(prior, 1e-4) / (1 - min(prior, 0.9999))))
    if not positive or not unlabelled:
        return {-1: bias}
    p, u = frequencies(positive, 1 << BITS), frequencies(unlabelled, 1 << BITS)
    rate_p, rate_u = p / len(positive), u / len(unlabelled)
    both = (p + u + 1) / (len(positive) + len(unlabelled))
    deviations = (rate_p - rate_u) / np.sqrt(both * (1 / len(positive) + 1 / len(unlabelled)))
    kept = np.flatnonzero((p >= 3) & (rate_p > 3 * rate_u) & (deviations > 3))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    d = len(kept)
    rows = [[np.concatenate([number[r][number[r] >= 0], [d]]) for r in x] for x in (positive, unlabelled)]
    xp, xu = Sparse(rows[0]), Sparse(rows[1])
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = bias
    for step in range(1, steps + 1):
        zp, zu = xp.times(w), xu.times(w)
        up = -sigmoid(-zp) / xp.n  # slope of the loss of z, averaged
        down_p, down_u = sigmoid(zp) / xp.n, sigmoid(zu) / xu.n  # of the loss of -z
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = xu.transposed_times(down_u, d + 1) - prior * xp.transposed_times(down_p, d + 1)
        g = prior * xp.transposed_times(up, d + 1) + negative if rest >= -beta else -gamma * negative
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:d] = np.sign(w[:d]) * np.maximum(np.abs(w[:d]) - shrink, 0)
    return {-1: float(w[d])} | {int(k): float(x) for k, x in zip(kept, w[:d], strict=True)}


class Scorer(dict):
    """Token -> its part of the logit, filled when first asked for."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights, self.bias = weights, weights[-1]

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        get = self.weights.get
        out = self[token] = sum(get(f, 0.0) for f in word_features(token))
        return out

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.__getitem__, sorted(set(text.lower().split()))))
        return float(sigmoid(np.float64(z)))


def fit(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """A model from labels (doc_id, toxic) of rows that aren't held out, and unlabelled docs that aren't either.

    The prior is the toxic share of all labels that may be learned from; labels other than 0 and 1 are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    prior = known.agg(F.avg("label")).first()[0]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id")))
    some = sampled(known.where("label = 1"), POSITIVES).unionByName(sampled(ids, UNLABELLED).withColumn("label", F.lit(0)))
    rows, y = feature_rows(docs, some, lambda: features)
    return train([r for r, k in zip(rows, y, strict=True) if k], [r for r, k in zip(rows, y, strict=True) if not k], prior or 0.05)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Texts are read whole; null ones are empty and get the bias alone. Neither labels nor lang, source or doc_id enter a
    score. Repeated rows give repeated results; without labels the score is a constant; an empty table gives an empty
    result.
    """
    weights = fit(docs, labels)
    return scores(docs, lambda: Scorer(weights).score, threshold)
