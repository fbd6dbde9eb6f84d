"""Which span encloses a place: an interval join of equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of the smallest block, and doublings of it up to the largest.
WIDTH, LEVELS = 16, 40


def enclosing(spans: DataFrame, places: DataFrame, every: bool = False) -> DataFrame:
    """Each place (file_path, line and others) with id, start, end of the smallest span (file_path, id, start, end,
    both ends inside) that holds its line; with every, of each that does. Places that no span holds are left out.

    A span lies in at most two blocks of the smallest size that isn't below its length; blocks of a size are half as many as
    those of the one before. A place looks into its block of each size that its file has spans of, so rows grow with spans
    and places, not with their product, and long spans give no more rows than short ones. Of spans of one length the one
    that starts last, then the smallest id wins. Spans that end before they start, and nulls, hold nothing.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("end") - F.col("start") + 1) / F.lit(float(WIDTH))))).cast("int")
    block = lambda c, k: F.floor(F.col(c) / (F.lit(WIDTH) * F.pow(F.lit(2.0), k))).cast("long")
    held = spans.select("file_path", "id", "start", "end").where("start <= end").withColumn("_level", F.least(level, F.lit(LEVELS)))
    held = held.withColumn("_block", F.explode(F.sequence(block("start", F.col("_level")), block("end", F.col("_level")))))
    sizes = held.groupBy("file_path").agg(F.collect_set("_level").alias("_levels"))  # at most LEVELS + 1
    named = places.withColumn("_place", F.xxhash64(*[F.col(f"`{c}`") for c in places.columns]))
    asked = named.join(sizes, "file_path").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_block", block("line", F.col("_level")))
    hits = asked.join(held, ["file_path", "_level", "_block"]).where("line between start and end").drop("_level", "_block")
    if every:
        return hits.drop("_place")
    best = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("later"), "id")
    one = hits.groupBy("_place", *places.columns).agg(F.min_by(F.struct("id", "start", "end"), best).alias("_span"))
    return one.select(*places.columns, "_span.*")
