"""Document fingerprints by locally consistent parsing.

A text's symbols are parsed into phrases, phrases into longer ones, level by level. Runs of one symbol are one phrase, so
neighbours differ; deterministic coin tossing then shrinks the names: a symbol's label is the lowest bit in which it
differs from its left neighbour, and that bit's value, over and over until six labels are left; phrases begin where the
label is larger than both neighbours'. Where a phrase begins depends on a few symbols near it alone, and a phrase's name
is a hash of what it holds, so equal substrings get equal phrases but for some at their ends, at any offset and in any
document. The fingerprint is a minimum-wise sample of the names of phrases from the second level up.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, text_of

#: Lanes of a fingerprint (a byte each), levels of phrases, and the first level whose names are sampled.
LANES, LEVELS, FIRST = 128, 4, 2
#: Characters parsed at a time: texts together up to it, a longer one by itself.
AT_ONCE = 1 << 19
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x.copy()
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(32)
    return x


@lru_cache(1)
def weights() -> np.ndarray:
    """An odd number for each place in a phrase; they come round again after 64."""
    return mixed(np.arange(1, 65, dtype=U)) | U(1)


def named(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at these places and reach to the next: hashes of their symbols in order."""
    lengths = np.diff(begins, append=len(names))
    place = np.arange(len(names)) - np.repeat(begins, lengths)
    return mixed(np.add.reduceat(names * weights()[place & 63], begins) + lengths.astype(U))


def tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours, from names that differ for neighbours; first marks texts' beginnings."""
    differ = np.empty_like(names)
    differ[1:] = names[1:] ^ names[:-1]
    differ[:1] = 1
    differ[first] = names[first] | U(1 << 63)  # a text's first symbol is held against nothing
    lowest = np.bitwise_count((differ & (~differ + U(1))) - U(1))
    labels = lowest << 1 | ((names >> lowest.astype(U)) & U(1)).astype(np.uint8)
    for _ in range(3):  # 128 labels, 14, 8, 6
        d = np.empty_like(labels)
        d[1:] = labels[1:] ^ labels[:-1]
        d[:1] = 1
        d[first] = labels[first] | 0x80
        lowest = np.bitwise_count((d & (~d + np.uint8(1))) - np.uint8(1))
        labels = lowest << 1 | ((labels >> lowest) & 1)
    return labels


def level(names: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and the text that each belongs to."""
    if not len(names):
        return names, text
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    if not fresh.all():
        begins = np.flatnonzero(fresh)
        lengths = np.diff(begins, append=len(names))
        text, runs = text[begins], names[begins]
        names = np.where(lengths > 1, mixed(runs + lengths.astype(U) * U(0x2545F4914F6CDD1D)), runs)
        same = np.flatnonzero((names[1:] == names[:-1]) & (text[1:] == text[:-1])) + 1  # a chance in 2^64
        names[same] ^= U(1)
    first = np.ones(len(names), bool)
    first[1:] = text[1:] != text[:-1]
    labels = tossed(names, np.flatnonzero(first))
    begin = first.copy()
    if len(names) > 2:
        begin[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    begins = np.flatnonzero(begin)
    return named(names, begins), text[begins]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of LANES bytes for each text; zeros for an empty one."""
    n = len(texts)
    best = np.full((n, LANES), np.iinfo(U).max, U)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    names = mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U) + U(1))
    text = np.repeat(np.arange(n), lengths)
    for depth in range(1, LEVELS + 1):
        names, text = level(names, text, n)
        if depth >= FIRST and len(names):
            lane = (names >> U(57)).astype(np.int64)
            np.minimum.at(best.reshape(-1), text * LANES + lane, mixed(names ^ U(0x5851F42D4C957F2D)))
    # a lane without a phrase takes the next lane that has one, altered by the distance
    empty = best == np.iinfo(U).max
    hollow = np.flatnonzero(empty.any(1) & ~empty.all(1))
    if len(hollow):
        rows, gaps = best[hollow], empty[hollow]
        twice = np.concatenate([np.where(gaps, 2 * LANES, np.arange(LANES)), np.where(gaps, 2 * LANES, np.arange(LANES, 2 * LANES))], axis=1)
        nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :LANES]
        distance = (nearest - np.arange(LANES)).astype(U)
        best[hollow] = np.take_along_axis(rows, nearest % LANES, 1) + distance * U(0x9E3779B97F4A7C15)
    out = (mixed(best) >> U(56)).astype(np.uint8)
    out[empty.all(1)] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal lanes, less what chance gives lanes of a byte, from 0 to 1."""
    return np.clip(((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256), 0, 1)


def batches_of(texts: list[str]) -> np.ndarray:
    """fingerprints() of any number of texts, AT_ONCE characters at a time."""
    out, some, size = [], [], 0
    for t in texts:
        if some and size + len(t) > AT_ONCE:
            out.append(fingerprints(some))
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        out.append(fingerprints(some))
    return np.concatenate(out) if out else np.zeros((0, LANES), np.uint8)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of text replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, rows_a_part: int = 1024, most_parts: int = 1 << 16) -> DataFrame:
    """doc_id, text, hash, part, role: rows dealt to parts of neighbouring ids, for a reader of each part in the order of
    part, role, doc_id descending, hash of the text, text. Role 0 is a part's own row; role 1 the first row of the next part
    (after the last: of the first), so that each row meets its successor within its part.

    Parts end at quantiles of the ids, so their sizes are even however the ids lie; ids may be any longs. Null ids are the
    smallest. An id of many rows is a row of parts of its own, by the text's hash; a text that one id has many times, whose
    order doesn't matter, by its place in the input. The driver gets a cut, a frequent id or text and a row for each part.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("at", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
    least, n = rows.agg(F.min("doc_id"), F.count(F.lit(1))).first()
    parts = max(1, min(most_parts, n // rows_a_part))
    often = max(rows_a_part, n // most_parts)
    # the distance from the smallest id, as doubles: in the order of the ids, and beyond the range of longs
    offset = F.coalesce((F.col("doc_id").cast("decimal(20,0)") - F.lit(str(least or 0)).cast("decimal(20,0)")).cast("double"), F.lit(-1.0))
    cuts = rows.agg(F.percentile_approx(offset, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    cuts = np.unique(np.array(cuts or [], np.float64))
    ids = [(r.doc_id, r["n"]) for r in rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).collect()]
    same = []
    if ids:
        frequent = F.broadcast(docs.sparkSession.createDataFrame(ids, "frequent long, n long").drop("n"))  # a row a part
        same = [(r.doc_id, r.hash, r["n"]) for r in rows.join(frequent, F.col("doc_id").eqNullSafe(F.col("frequent"))).groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).collect()]
    levels = [np.array([(i is None, ~(i or 0), h, -(-k // rows_a_part)) for i, h, k in found], np.int64).reshape(-1, 4) for found in ([(i, 0, k) for i, k in ids], same)]

    def place(of: np.ndarray, null: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many parts the frequent ids and texts up to each row make: k and one before the rows after it."""
        out = np.zeros(len(of), np.int64)
        for known, by_hash, u in ((levels[0], 0, (hashes >> 44) + (1 << 19)), (levels[1], 1, at)):  # u: 0 to 2^20, of hashes in their order
            keys = np.concatenate([known[:, :3], np.stack([null, ~of, hashes * by_hash], 1)])
            of_row = np.arange(len(keys)) >= len(known)
            order = np.lexsort((of_row, keys[:, 2], keys[:, 1], keys[:, 0]))
            parts_of = np.concatenate([known[:, 3], np.zeros(len(of), np.int64)])
            made = np.cumsum(np.where(of_row, 0, parts_of + 1)[order])
            last = np.maximum.accumulate(np.where(of_row[order], -1, np.arange(len(keys))))
            mine = (last >= 0) & (keys[order[np.maximum(last, 0)]] == keys[order]).all(1)
            k = np.where(mine, parts_of[order[np.maximum(last, 0)]], 0)
            inside = np.concatenate([np.zeros(len(known), np.int64), u])[order] * k >> 20
            found = np.empty(len(keys), np.int64)
            found[order] = made - k + inside
            out += found[len(known) :]
        return out

    @F.pandas_udf("int")
    def part_of(x: pd.Series, of: pd.Series, null: pd.Series, hashes: pd.Series, at: pd.Series) -> pd.Series:
        first = len(cuts) - np.searchsorted(cuts, x.to_numpy(np.float64))
        return pd.Series((first + place(of.to_numpy(np.int64), null.to_numpy(bool), hashes.to_numpy(np.int64), at.to_numpy(np.int64))).astype(np.int32))

    split = part_of(offset, F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), "hash", "at")
    dealt = rows.withColumn("part", split if len(cuts) or ids else F.lit(0)).drop("at")
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("less"), "hash")
    found = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min_by(F.struct("doc_id", "hash"), order).alias("top")).select("part", "top.*").collect())
    before = [(p, found[i - 1][0], top, h) for i, (p, top, h) in enumerate(found)]
    tops = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before int, top long, top_hash long"))  # a row a part
    heads = dealt.join(tops, "part").where(F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("hash") == F.col("top_hash")))
    heads = heads.groupBy("before").agg(F.first("top").alias("doc_id"), F.first("top_hash").alias("hash"), F.min("text").alias("text"))
    ahead = heads.select("doc_id", "text", "hash", F.col("before").alias("part"), F.lit(1).alias("role"))
    return dealt.withColumn("role", F.lit(0)).unionByName(ahead)


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    A row's edited text takes its last half from the next row in descending doc_id, which may be any long (rows of equal
    doc_id by the text's hash and by text, null ids last; the last row's next is the first; a single row's next is itself). Null texts are empty:
    their fingerprint is zeros, and two such are alike. An empty table gives an empty result; other columns are not read.
    Texts are dealt once; a part is read as a stream with a bounded number of rows in memory. A long text is parsed as a
    whole by one worker, in some 60 bytes a character.
    """
    spark = docs.sparkSession
    rows = in_order(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "role", F.desc_nulls_last("doc_id"), "hash", "text").select("doc_id", "text", "part", "role")

    def run(batches):
        held = None  # the part's last own row: id, text, part, fingerprint

        def pairs(cur, nxt):
            ids, texts = [c[0] for c in cur], [c[1] for c in cur]
            changed = [edited(t, x[1]) for t, x in zip(texts, nxt, strict=True)]
            own, then = np.stack([c[3] for c in cur]), np.stack([x[3] for x in nxt])
            other = batches_of(changed)
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([r.tobytes().hex() for r in own]),
                       pa.array([r.tobytes().hex() for r in other]), pa.array(likeness(own, other)), pa.array(likeness(own, then))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(1).to_pylist()
                marks = batches_of(texts)
                cur, nxt = [], []
                for i, (d, t, p, role) in enumerate(zip(some.column(0).to_pylist(), texts, some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)):
                    row = (d, t, p, marks[i])
                    if held is not None and held[2] == p:
                        cur.append(held)
                        nxt.append(row)
                    held = row if role == 0 else None  # the first row of role 1 ends its part
                if cur:
                    yield pairs(cur, nxt)

    return in_batches(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
