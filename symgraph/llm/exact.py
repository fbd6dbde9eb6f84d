"""Exact deduplication by composable polynomial fingerprints.

A text's bytes b_0..b_{n-1} are read as the digits of a number, sum(b_i * BASE^(n-1-i)) modulo the prime 2^31 - 1, for
two bases. Fingerprints of neighbouring chunks combine by arithmetic alone, f(xy) = f(x) * BASE^len(y) + f(y), so chunks
of one huge text are hashed in any order and place. Equal fingerprints only nominate: the chunks of the nominated texts
are then compared with one another, and a group that isn't truly equal falls apart by the texts' SHA-256.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, per_batch, rows_of, text_of, unused
from symgraph.session import broadcast_if, materialise

PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_069)
#: Bytes hashed at a time, and compared at a time.
CHUNK = 1 << 16
#: Most rows of a broadcast side: pairs of longs, 32 MB at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts of more bytes are cut into parts of PART bytes, which any task hashes.
LARGE, PART = 1 << 24, 1 << 22


@lru_cache(4)
def powers(base: int, prime: int) -> np.ndarray:
    """base^(CHUNK-1) .. base^0 modulo prime."""
    out = np.empty(CHUNK, np.int64)
    x = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


def chunk_hash(chunk: np.ndarray, base: int, prime: int = PRIME) -> int:
    """Fingerprint of at most CHUNK bytes; products stay below 2^39 and their sum below 2^55."""
    return int(np.dot(chunk.astype(np.int64), powers(base, prime)[CHUNK - len(chunk) :])) % prime


def combine(left: int, right: int, right_bytes: int, base: int, prime: int = PRIME) -> int:
    """Fingerprint of two neighbours from theirs: the left one is shifted by the right one's length."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def fingerprint(data: bytes, prime: int = PRIME) -> int:
    """Both bases' fingerprints in one non-negative 62-bit integer, combined chunk by chunk."""
    found = [0, 0]
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), CHUNK):
        chunk = view[at : at + CHUNK]
        for k, base in enumerate(BASES):
            h = chunk_hash(chunk, base, prime)
            found[k] = combine(found[k], h, len(chunk), base, prime) if at else h
    return found[0] << 31 | found[1]


def fingerprints(docs: DataFrame, prime: int = PRIME) -> DataFrame:
    """doc_id, n_bytes, print (of the whole text), text_sha256, x (xxHash64 of the text)."""
    schema = "doc_id long, n_bytes long, print long, text_sha256 string, x long"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, p, sha = [], [], []
            for _, text in rows_of(batch, "text"):
                data = text.encode()
                n.append(len(data))
                p.append(fingerprint(data, prime))
                sha.append(hashlib.sha256(data).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(sha, pa.string()), batch.column(2)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "print", "text_sha256", "x"])

        return each

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("x", F.xxhash64("text"))
    large = F.octet_length("text") > LARGE
    small = in_batches(rows.where(~large)).mapInArrow(per_batch(make), schema)
    huge = rows.where(large).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "x")
    huge = materialise(huge, "exact-huge")
    if huge.isEmpty():
        return small
    prints = materialise(huge_prints(rows.where(large), prime), "exact-huge-prints")
    return small.unionByName(huge.join(broadcast_if(prints, BROADCAST_ROWS), "text_sha256").select(*small.columns))


def huge_prints(rows: DataFrame, prime: int = PRIME) -> DataFrame:
    """text_sha256 and print of each text: its parts are dealt over all tasks, and their fingerprints combined in order."""

    def hashed(batches):
        for b in batches:
            p = [fingerprint(b.column(3)[i].as_py(), prime) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p, pa.int64())], names=["text_sha256", "part", "n", "print"])

    def combined(batches):
        for b in batches:
            out = []
            for parts in b.column(1):
                found = [0, 0]
                for r in parts.as_py():
                    for k, base in enumerate(BASES):
                        found[k] = combine(found[k], r["print"] >> 31 if k == 0 else r["print"] & PRIME, r["n"], base, prime)
                out.append(found[0] << 31 | found[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["text_sha256", "print"])

    texts = rows.select(F.sha2("text", 256).alias("text_sha256"), F.encode("text", "utf-8").alias("data"))
    parts = texts.select("text_sha256", "data", F.explode(F.sequence(F.lit(0), F.expr(f"int((octet_length(data) - 1) div {PART})"))).alias("part"))
    parts = parts.select("text_sha256", "part", F.expr(f"substring(data, part * {PART} + 1, {PART})").alias("data"))
    parts = parts.select("text_sha256", "part", F.octet_length("data").cast("long").alias("n"), "data").repartition("text_sha256", "part")
    done = in_batches(parts).mapInArrow(hashed, "text_sha256 string, part int, n long, print long").dropDuplicates(["text_sha256", "part"])
    whole = done.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("part", "n", "print"))).alias("parts"))
    return whole.mapInArrow(combined, "text_sha256 string, print long")


def unequal(docs: DataFrame, groups: DataFrame, prime: int = PRIME) -> DataFrame:
    """print and n_bytes of the groups whose texts are not all equal, found chunk by chunk.

    Only texts that are in a group of several are read again past the scan (a semi-join on the text's own hash). For each
    chunk number the group's smallest and largest chunk are kept, which is combined before the shuffle, so a group with a
    third of all rows sends one row a task and chunk; they are equal iff all chunks are. Chunks are cut from the text's
    bytes, each in time of its own length.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("key", F.xxhash64("text"))
    named = groups.select("print", "n_bytes", F.explode("xs").alias("key")).distinct()
    texts = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).join(broadcast_if(named, BROADCAST_ROWS), ["key", "n_bytes"])
    texts = texts.select("print", "n_bytes", F.encode("text", "utf-8").alias("data"))  # by itself, so that it is done once a text
    chunks = texts.select("print", "n_bytes", "data", F.explode(F.expr(f"sequence(0, int(greatest(n_bytes - 1, 0) div {CHUNK}))")).alias("chunk"))
    chunks = chunks.withColumn("part", F.expr(f"substring(data, chunk * {CHUNK} + 1, {CHUNK})"))
    ends = chunks.groupBy("print", "n_bytes", "chunk").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return ends.where("low != high").select("print", "n_bytes").distinct()


def exact_groups(docs: DataFrame, prime: int = PRIME) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, x.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays (a null
    doc_id is the smallest); of repeated rows, equal in doc_id and text, one. Empty tables give empty results; columns
    other than doc_id and text are not read.
    """
    rows = fingerprints(docs, prime).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "exact-prints")
    key = ["print", "n_bytes"]
    several = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2")).where("n > 1")
    several = several.select(*key, F.array("x1", "x2").alias("xs"))
    broken = materialise(unequal(docs, materialise(several, "exact-several"), prime), "exact-unequal")
    split = rows.join(broadcast_if(broken.withColumn("apart", F.lit(True)), BROADCAST_ROWS), key, "left")
    split = split.withColumn("apart", F.when(F.col("apart"), F.col("text_sha256")).otherwise(F.lit("")))
    key.append("apart")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
    groups = split.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best)
    many = materialise(groups.where("group_size > 1"), "exact-many")
    found = split.join(broadcast_if(many, BROADCAST_ROWS), key, "left")
    alone = F.col("best").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == -F.col("row"))).alias("kept"),
        "text_sha256",
        "x",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_groups drops; all columns stay.

    Only the dropped rows' ids and hashes go to the other side of an anti-join, so the texts that stay are not shuffled
    while those fit a broadcast. Repeated rows share both, so a kept row that has a repeated twin is put back once.
    """
    found = materialise(exact_groups(docs), "exact-groups")
    mark = found.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
    return without(docs, mark.where("n > 1 or not stays"))


def without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without the rows of marked (doc_id, x, stays); of rows that stay and are equal in doc_id and text, one is left.

    A null doc_id is a value like others, a null text equals an empty one, long texts are hashed where they lie, and empty
    tables on either side change nothing."""
    i, x = unused(docs, "gone_id", "gone_x")
    gone = materialise(marked.select(F.col("doc_id").alias(i), F.col("x").alias(x), "stays"), "gone")
    here = [F.col("doc_id").cast("long").eqNullSafe(F.col(i)), F.xxhash64(text_of()) == F.col(x)]
    rest = docs.join(broadcast_if(gone.select(i, x), BROADCAST_ROWS), here, "left_anti")
    twins = gone.where("stays").select(i, x)
    if twins.isEmpty():
        return rest
    return rest.unionByName(docs.join(broadcast_if(twins, BROADCAST_ROWS), here, "left_semi").dropDuplicates(["doc_id", "text"]))
