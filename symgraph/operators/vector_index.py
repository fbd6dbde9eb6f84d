"""Inverted lists of vectors: each vector is in the list of its nearest centroid, and a query looks into its nearest lists.

Centroids are trained on a bounded sample; every vector is indexed. The exact way is retrieval.vector_search().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.session import broadcast_if, materialise

#: Vectors that centroids are trained on at most, rounds of training, and vectors of a list that one task scores.
SAMPLE, ROUNDS, PART = 20_000, 12, 4_096


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length; a vector of zeros stays one."""
    flat = np.asarray(column.flatten(), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norm > 0, norm, 1)


def train(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids of unit length: spherical k-means on the at most SAMPLE vectors whose ids have the smallest hashes. Without
    lists, as many as the square root of four times the sample. The driver holds the sample."""
    some = vectors.where("vector is not null").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    x = _matrix(some.toArrow()["vector"].combine_chunks())
    k = max(1, min(len(x), lists or int(np.sqrt(4 * len(x)))))
    if not len(x):
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def listed(rows: DataFrame, centres: np.ndarray, column: str = "vector", probes: int = 1) -> DataFrame:
    """rows with list, one row for each of the probes lists whose centroids are nearest; rows without a vector have none."""
    schema = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes) + ", list int"

    def run(batches):
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index(column)))
            n = min(probes, len(centres))
            near = np.argpartition(-(x @ centres.T), n - 1, axis=1)[:, :n] if n else np.zeros((len(x), 0), int)
            at = np.repeat(np.arange(len(x)), n)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "list"])

    return rows.where(F.col(column).isNotNull()).mapInArrow(run, schema)


def scored(most: int):
    """The best most of each query against the vectors of one part of a list."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            scores = _matrix(queries["target"].combine_chunks()) @ _matrix(vectors["vector"].combine_chunks()).T
            names, asked = np.asarray(vectors["id"]), np.asarray(queries["query"])
            for q, row in zip(asked.tolist(), scores, strict=True):
                best = np.lexsort((names, -row))[:most]
                found["query"] += [q] * len(best)
                found["id"] += names[best].tolist()
                found["score"] += row[best].astype(float).tolist()
        return pa.table({"query": pa.array(found["query"], pa.int64()), "id": pa.array(found["id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    return run


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, most: int = 10, probes: int | None = None) -> DataFrame:
    """V5: query, id, score (cosine), place: the best most of each query (query, collection, target) in its nearest lists.

    index is listed() vectors (collection, id, vector), written. A list of more than PART vectors is scored in parts, so a
    crowded list is several tasks. More probes find more; as many as there are lists find all that vector_search() finds.
    Without a number, three fifths of the lists are probed: vectors without any clusters, as the test tables hold, need so
    many for nine tenths of the best ten; clustered ones need a few.
    Null and empty vectors are in no list; ids and queries are longs.
    """
    probes = probes or -(-3 * len(centres) // 5)
    parts = index.groupBy("collection", "list").agg(F.expr(f"(count(1) + {PART - 1}) div {PART}").alias("parts"))
    parts = broadcast_if(materialise(parts, "vector-lists", True), 100_000)
    stored = index.select("collection", "list", "id", "vector").join(parts, ["collection", "list"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    asked = listed(queries.select("query", "collection", "target"), centres, "target", probes).join(parts, ["collection", "list"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    by = ["collection", "list", "part"]
    found = stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(scored(most), "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most)
