"""What the classifiers share: folds, bounded training samples and sparse rows in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, per_batch, rows_of, text_of


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from."""
    return fold_of(doc_id) == 1


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most so many of the rows, the same ones each time: those whose doc_id has the smallest hashes."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


#: Characters that are learned from at most: of a sample with more, rows go, those whose ids have the largest hashes. A text
#: that is learned from is learned from as a whole.
MOST_CHARACTERS = 64 << 20


def affordable(sizes: list[tuple[int, int, int, int]], most: int) -> list[tuple[int, int]]:
    """doc_id and label of the first of the rows (hash, doc_id, label, characters), by hash, that have so many characters in
    all at most; of each label one row at least."""
    out, total, labels = [], 0, set()
    for _, i, label, n in sorted(sizes):
        if total + n <= most or label not in labels:
            out.append((i, label))
            labels.add(label)
        total += n
    return out


def feature_rows(docs: DataFrame, sample: DataFrame, features: Callable[[], Callable[[str], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sampled documents (doc_id, label): computed by the executors (features() runs once in a
    task), gathered as numbers.

    The sample is broadcast: its size is bounded by sampled(). Of documents with one doc_id the text with the smallest hash
    is learned from, once for each label. The driver gets whole texts' features, of MOST_CHARACTERS characters at most.
    """

    def make():
        of = features()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.array([of(t) for _, t in rows_of(batch, "text")], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "label", "features"])

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    wanted = sample.select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    joined = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("x"))
    first = joined.groupBy("doc_id", "label").agg(F.min(F.struct("x", "text")).alias("t")).select("doc_id", "label", "t.text")
    sizes = [(r.h, r.doc_id, r.label, r["n"]) for r in first.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.length("text").alias("n")).collect()]
    if sum(x[3] for x in sizes) > MOST_CHARACTERS:
        kept = docs.sparkSession.createDataFrame(affordable(sizes, MOST_CHARACTERS), "doc_id long, label int")
        first = first.join(F.broadcast(kept), ["doc_id", "label"])
    got = in_batches(first).mapInArrow(per_batch(make), "doc_id long, label int, features array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = got["features"].combine_chunks()
    return [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in lists], np.asarray(got["label"]).astype(np.int64)


def hashed(kind: str, name: str, bits: int) -> int:
    """A feature's number."""
    return zlib.crc32(f"{kind}\t{name}".encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


class Sparse:
    """Rows of feature numbers with values."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)
        self.ids = np.concatenate(rows).astype(np.int32) if self.lengths.sum() else np.zeros(0, np.int32)
        self.values = np.ones(len(self.ids), np.float32) if values is None else np.concatenate(values).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.ids] * self.values, self.n)

    def transposed_times(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.ids, g[self.at] * self.values, width)


def frequencies(rows: list[np.ndarray], width: int) -> np.ndarray:
    """In how many rows each feature occurs."""
    out = np.zeros(width)
    for r in rows:
        out[np.unique(r)] += 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def scores(docs: DataFrame, scorer: Callable[[], Callable[[str], float]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; scorer() runs once in a task."""

    def make():
        score = scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((score(t) for _, t in rows_of(batch, "text")), np.float64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return each

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), text_of().alias("text"))
    return in_batches(rows).mapInArrow(per_batch(make), "doc_id long, held_out boolean, score double, predicted int")
