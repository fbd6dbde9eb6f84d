"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and `most` times its text. Among all rates that meet every source's target of words,
those closest in (bounded) relative entropy to the common rate are an exponential tilt of it, most * s(b + t * size) with
the logistic function s, b from the common rate and one multiplier t a source. The multipliers maximise a concave dual;
Newton iterations find them, each one a distributed sum over the sources' size counts. Rates are then rounded into copies
of whole documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import WORD, text_of, unused
from symgraph.session import broadcast_if, materialise

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents whose copies are dealt out in one window.
CLASS_ROWS = 256
BROADCAST_ROWS = 100_000


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take of each source: share of all sizes by weight; none above most times its size, the excess reshared."""
    left, open_, out = share * sum(sizes.values()), {s for s in sizes if sizes[s] > 0}, {s: 0.0 for s in sizes}
    while open_:
        total = sum(weights[s] for s in sorted(open_, key=lambda s: (s is None, s or "")))
        over = {s for s in open_ if left * weights[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def rate(t, size, base: float, most: float, scale: float):
    """The tilted rate of documents of this size, and its derivative by t."""
    u = np.clip(math.log(base / (most - base)) + t * size / scale, -700, 700)
    s = 1 / (1 + np.exp(-u))
    return most * s, most * s * (1 - s) * size / scale


def solve(counts: DataFrame, goals: dict, total: int, n: int, share: float, most: float, rounds: int = 60, near: float = 1e-4) -> dict:
    """Each source's multiplier; counts has source, size, n. A source whose target is all it may give gets infinity.

    A step sums, over the cluster, the words that the present multipliers take and the sum's slope, by source; the
    driver holds a few numbers a source. Steps that leave the bracket of the root are halved into it. Targets that are not
    met after so many rounds are an error.
    """
    scale, base = max(1.0, total / max(1, n)), min(share, most * 0.999)
    t = {s: 0.0 for s in goals}
    low, high = {s: -math.inf for s in goals}, {s: math.inf for s in goals}
    done = {s for s, (goal, size) in goals.items() if size == 0 or goal >= most * size * (1 - 1e-9)}
    for s in done:
        t[s] = math.inf
    spark = counts.sparkSession
    for _ in range(rounds):
        todo = [s for s in goals if s not in done]
        if not todo:
            break
        now = spark.createDataFrame([(s, t[s]) for s in todo], "source string, t double")
        now = F.broadcast(now) if len(todo) <= BROADCAST_ROWS else now
        u = F.lit(math.log(base / (most - base))) + F.col("t") * F.col("size") / F.lit(scale)
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), u))))
        rows = counts.alias("c").join(now.alias("w"), F.expr("c.source <=> w.source")).select("c.source", "n", "size", s.alias("s"))
        words = F.col("n") * F.col("size") * F.lit(most) * F.col("s")
        sums = rows.groupBy("source").agg(F.sum(words).alias("f"), F.sum(words * (1 - F.col("s")) * F.col("size") / F.lit(scale)).alias("g"))
        for r in sums.collect():
            k, goal = r["source"], goals[r["source"]][0]
            gap = r["f"] - goal
            if abs(gap) <= near * goal:
                done.add(k)
                continue
            if gap > 0:
                high[k] = min(high[k], t[k])
            else:
                low[k] = max(low[k], t[k])
            step = t[k] - gap / r["g"] if r["g"] > 0 else math.inf * -gap
            if low[k] < step < high[k] and abs(step - t[k]) <= 2 + 4 * abs(t[k]):
                t[k] = step
            elif math.isinf(low[k]):
                t[k] = min(-1.0, 2 * high[k] if high[k] < 0 else -1.0)
            elif math.isinf(high[k]):
                t[k] = max(1.0, 2 * low[k] if low[k] > 0 else 1.0)
            else:
                t[k] = (low[k] + high[k]) / 2
    if left := [s for s in goals if s not in done]:
        raise RuntimeError(f"{len(left)} sources did not meet their targets in {rounds} steps: {left[:5]}")
    return t


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, x (hash of
    doc_id and text), taken (size * copies).

    Size is the number of words; null texts have none; a null source is a source of its own, the last. Sources by code
    point take the weights in turn. Reruns agree: rounding goes by size and by a hash of doc_id and text, never by a
    random number. Documents of one size in one source share a rate, so their copies are dealt as a whole: the class gets
    the number that brings the source's running total, over sizes from the largest, nearest to its goal (off by half a
    document of the smallest size that can still move it), and its documents get them evenly, in dealing groups of
    CLASS_ROWS. Repeated rows are documents of their own; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_of().alias("text"))
    rows = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("x"))
    rows = materialise(rows, "mix-sizes")
    counts = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    per = {r["source"]: r for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")).collect()}
    names = sorted(per, key=lambda s: (s is None, s or ""))
    words = {s: per[s]["words"] for s in names}
    goal = targets(words, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share, most)
    total, n = sum(words.values()), sum(r["docs"] for r in per.values())
    tilt = solve(counts, {s: (goal[s], words[s]) for s in names}, total, n, share, most)
    scale, base = max(1.0, total / max(1, n)), min(share, most * 0.999)
    known = {s: (float(goal[s]), int(words[s]), float(tilt[s])) for s in names}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        target, source_size, t = known[None if pd.isna(source) else source]
        pdf = pdf.sort_values("size", ascending=False)
        size, many = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        rates = np.full(len(size), float(most)) if math.isinf(t) else rate(t, size, base, most, scale)[0]
        ahead, copies = 0.0, np.zeros(len(size), np.int64)
        for i in range(len(size)):
            if size[i]:
                ahead += rates[i] * size[i] * many[i]
                copies[i] = min(most * many[i], max(0, round(ahead / size[i])))
                ahead -= copies[i] * size[i]
            else:
                copies[i] = many[i]
        return pd.DataFrame({"source": pdf["source"], "size": size, "n": many, "class_copies": copies, "source_size": source_size, "target": target})

    # one row for each size of a source: at most as many as the largest size, however many documents there are
    dealt = counts.groupBy("source").applyInPandas(deal, "source string, size long, n long, class_copies long, source_size long, target double")
    dealt = materialise(dealt, "mix-classes")
    joined = rows.alias("r").join(dealt.alias("d"), F.expr("r.source <=> d.source and r.size = d.size"))
    joined = joined.select("doc_id", "r.source", "r.size", "x", "n", "class_copies", "source_size", "target")
    extra = F.col("class_copies") % F.col("n")
    plain = joined.withColumn("base", F.expr("class_copies div n")).withColumn("extra", extra)
    even = plain.where("extra = 0").select("doc_id", "source", "size", "source_size", "target", F.col("base").alias("copies"), "x")
    # the documents with the smallest hashes get one more; large classes are dealt in groups, each with its share
    uneven = plain.where("extra > 0").withColumn("groups", F.expr(f"(n + {CLASS_ROWS - 1}) div {CLASS_ROWS}")).withColumn("part", F.pmod(F.xxhash64("x"), F.col("groups")))
    keyed = materialise(uneven, "mix-uneven")
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("size"), F.col("part")]
    shares = keyed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part"))
    quota = shares.withColumn("upto", before).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), F.expr("(upto * extra) div n - ((upto - m) * extra) div n").alias("quota"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("x", F.col("doc_id")))
    ranked = keyed.withColumn("place", place).alias("k").join(quota.alias("q"), F.expr("k.source <=> q.s and k.size = q.z and k.part = q.p"))
    odd = ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("place") <= F.col("quota")).cast("long")).alias("copies"), "x")
    return even.unionByName(odd).withColumn("taken", F.col("size") * F.col("copies"))



def repeated(docs: DataFrame) -> DataFrame:
    """docs as mixed: each row as often as it has copies, none for 0; all columns stay; nulls and empty tables as in mix().

    The copies are joined back by the hash of doc_id and text; rows equal in both take their copies together: the sum is
    put on one row each.
    """
    taken = mix(docs.select("doc_id", "text", "source")).groupBy("x").agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows"))
    taken = materialise(taken, "mix-copies")
    x, n, each = unused(docs, "mix_x", "mix_n", "mix_each")
    here = F.xxhash64(F.col("doc_id").cast("long"), text_of()) == F.col(x)
    once = broadcast_if(taken.where("rows = 1 and sum != 1").select(F.col("x").alias(x), F.col("sum").alias(n)), BROADCAST_ROWS * 10)
    twins = taken.where("rows > 1").select(F.col("x").alias(x), F.col("sum").alias(n))
    some, single = docs, None
    if not twins.isEmpty():
        twins = broadcast_if(materialise(twins, "mix-twins"), BROADCAST_ROWS)
        single = docs.join(twins.select(x), here, "left_semi").dropDuplicates(["doc_id", "text"]).join(twins, here)
        some = docs.join(twins.select(x), here, "left_anti")
    out = some.join(once, here, "left").withColumn(n, F.coalesce(n, F.lit(1)))
    out = out if single is None else out.unionByName(single)
    return out.where(F.col(n) > 0).withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*docs.columns)
