"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from symgraph.session import merged_if, shared_path

#: Rows that are broadcast at most: a job has some fifty such joins, and the driver holds all of them for a while.
BROADCAST_ROWS = 30_000


def _smallest(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, written to the shared folder, and their number and two sums of 95 bits that tell one set from another."""
    seen, path = Observation(), shared_path(edges.sparkSession, "edges")
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("v", "u"), 33)).alias("s")]
    edges.observe(seen, *sums).write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), tuple(seen.get[k] for k in "nxs")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (u, v): root is the smallest node it is connected with.

    Alternates two contractions until nothing changes: each node's larger neighbours, then its smaller ones, are linked
    to its smallest neighbour. A round is one job, which writes its edges to the shared folder; a hub's edges meet only in
    partial minima and in a merge join whose large partitions Spark can split; nothing is broadcast. Self-links and repeated links are allowed; nodes
    can be of any ordered type; links with a null are none; no edges give no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, was = _written(now)
    for _ in range(most_rounds if was[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_smallest(large).hint("merge"), "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now, size = _written(now.where("u != v").distinct())
        if size == was:
            break
        was = size
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def chained(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root of roots followed by more (both node, root, and written): more chains nodes that are roots, or alone, in roots."""
    last = more.select(F.col("node").alias("root"), F.col("root").alias("last"))
    known = roots.join(merged_if(last, BROADCAST_ROWS), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return known.unionByName(more.join(merged_if(roots.select("node"), BROADCAST_ROWS), "node", "left_anti"))
