"""SimHash near-duplicates: fingerprints within 4 of 64 bits are linked, and links chained to components.

Candidates come from Golay-code fuzzy hashing. The fingerprint is cut into three segments of 22, 21 and 21 bits. With 4
differing bits or fewer, either a segment is equal and another differs in 2 bits at most (the equal one's bits with a
Golay key of the other: 33 bits), or all three differ and two of them in exactly one bit. These two segments then differ
in parity, so it is enough that each word of even parity gives its own nearest codeword and each of odd parity all its
keys (24 bits, and whether both parities are alike, which they are for both texts or for neither). A fingerprint has some
60 keys; two that share one are candidates and are verified. Beyond WIDE distinct fingerprints, 24 bits would meet too
often by chance; then the third segment, which differs in two bits at most, adds its Golay key (36 bits, some 190 keys).
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm import golay
from symgraph.llm.common import in_batches, per_batch, rows_of, text_of
from symgraph.llm.components import BROADCAST_ROWS, chained, components
from symgraph.llm.exact import without
from symgraph.session import materialise, merged_if, rows

SEED = 42
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16
#: Fingerprints of which one task makes keys, and members from which on a bucket is split further.
PRINTS_IN_TASK, CROWD = 50_000, 64
#: Distinct fingerprints from which on keys are wide. Links are the same either way.
WIDE = 30_000_000


def fingerprint(text: str, size: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.encode().lower().split()  # of bytes: A-Z only; splits at space and 0x09-0x0D
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return int.from_bytes(hashed(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long), x (the text's own hash)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(t, size) for _, t in rows_of(batch, "text")), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "print", "x"])

        return each

    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("x", F.xxhash64("text"))
    return in_batches(texts).mapInArrow(per_batch(make), "doc_id long, print long, x long")


def crossed(i: np.ndarray, k: np.ndarray, j: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All of k with all of m at each of n positions; i and j are their positions. The result is position and k << 12 | m."""
    order = np.argsort(j, kind="stable")
    m, times = m[order], np.bincount(j, minlength=n)
    first = np.cumsum(times) - times
    each = times[i]
    left = np.repeat(np.arange(len(i)), each)
    inner = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    return i[left], k[left].astype(np.int64) << 12 | m[first[i[left]] + inner].astype(np.int64)


def keys_of(prints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions in prints (unsigned) and their keys."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for low, bits in SEGMENTS]
    near = [golay.keys(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    at, out = [], []
    kind = 0
    for a, b in permutations(range(3), 2):
        i, k = near[b]
        at.append(i)
        out.append((np.int64(kind) << 40) | parts[a][i].astype(np.int64) << 12 | k.astype(np.int64))
        kind += 1
    # even parity: the nearest codeword; odd: all keys
    some = []
    for p, (i, k) in zip(parts, near, strict=True):
        odd = (np.bitwise_count(p) & 1).astype(bool)
        even = np.flatnonzero(~odd)
        some.append((np.concatenate([i[odd[i]], even]), np.concatenate([k[odd[i]], golay.nearest(p[even])])))
    for a, b in combinations(range(3), 2):
        i, pair = crossed(*some[a], *some[b], len(prints))
        if wide:
            i, pair = crossed(i, pair, *near[3 - a - b], len(prints))
        alike = (np.bitwise_count(parts[a][i]) + np.bitwise_count(parts[b][i])) & 1
        at.append(i)
        out.append((np.int64(kind) << 40) | alike.astype(np.int64) << 36 | pair)
        kind += 1
    return np.concatenate(at), np.concatenate(out)


def odd_of() -> Column:
    """Of a key that needs two parities, the first segment's parity in this fingerprint; else null."""
    kind, out = F.shiftright("key", 40), F.lit(None).cast("int")
    for k, (a, _) in enumerate(combinations(range(3), 2)):
        low, bits = SEGMENTS[a]
        out = F.when(kind == 6 + k, F.bit_count(F.col("print").bitwiseAND(F.lit(((1 << bits) - 1) << low))) % 2).otherwise(out)
    return out


def key_rows(prints: DataFrame, wide: bool = False) -> DataFrame:
    """key, print for each key of each distinct fingerprint."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.asarray(batch.column(0)).astype(np.int64)
            at, k = keys_of(p.view(np.uint64), wide)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(p[at])], names=["key", "print"])

        return each

    return prints.select("print").mapInArrow(per_batch(make), "key long, print long")


def _spread_out(prints: DataFrame) -> DataFrame:
    """prints, counted, over so many tasks that each gives some million keys at most."""
    return prints.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, rows(prints) // PRINTS_IN_TASK))


def turned(prints: np.ndarray) -> np.ndarray:
    """The same bits in another order, in which neighbours stand apart."""
    out = np.zeros_like(prints)
    for i in range(64):
        out |= (prints >> np.uint64(i) & np.uint64(1)) << np.uint64(i * 27 % 64)
    return out


def split(members: DataFrame) -> DataFrame:
    """members (key, print and others) of large buckets, with sub: a row for each key of the print's turned bits. Two that
    are near share one of these too, so pairs need only be sought within (key, sub)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.asarray(batch.column(batch.schema.get_field_index("print"))).astype(np.int64)
            at, k = keys_of(turned(p.view(np.uint64)))
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(k)], names=[*batch.schema.names, "sub"])

        return each

    return members.mapInArrow(per_batch(make), ", ".join(f"{n} {kind}" for n, kind in members.dtypes) + ", sub long")


def linked(prints: DataFrame, most: int = 4, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables of node, root: what links within most bits chain together of distinct fingerprints (print, counted). The
    second one chains roots of the first; fingerprints without a link are in neither.

    First each bucket's members are held against its smallest one; most large groups become one component by that. Then
    only pairs from different components are made, in buckets that hold several, so that a group of near copies doesn't
    give all its pairs and yet no link that would join two components is missed. Such buckets of more than CROWD members
    are split by further keys before. Buckets of keys that need two different parities count only if they hold both.
    """
    keyed = key_rows(_spread_out(prints), wide).withColumn("odd", odd_of())
    several = (F.col("low") != F.col("high")) & ((F.col("key") < F.lit(6 << 40)) | (F.col("some") != F.col("all")))
    buckets = keyed.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.max("odd").alias("some"), F.min("odd").alias("all")).where(several)
    shared = materialise(keyed.join(buckets.select("key", "low").hint("merge"), "key"), "simhash-keys")
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most
    stars = shared.where(within("print", "low") & (F.col("print") != F.col("low"))).select(F.col("print").alias("u"), F.col("low").alias("v"))
    roots = materialise(components(stars), "simhash-roots", True)
    named = shared.join(merged_if(roots, BROADCAST_ROWS), F.col("print") == F.col("node"), "left")
    named = materialise(named.select("key", "print", "odd", F.coalesce("root", "print").alias("root")), "simhash-named")
    mixed = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("key", "n")
    mixed = materialise(mixed, "simhash-mixed", True)
    left = materialise(named.join(merged_if(mixed.select("key"), BROADCAST_ROWS), "key", "left_semi"), "simhash-open")
    crowded = merged_if(materialise(mixed.where(F.col("n") > CROWD).select("key"), "simhash-crowded", True), BROADCAST_ROWS)
    few = left.join(crowded, "key", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    left = few.unionByName(split(left.join(crowded, "key", "left_semi")))
    one, two = left.select("key", "sub", F.col("print").alias("u"), F.col("root").alias("a"), "odd"), left.select("key", "sub", F.col("print").alias("v"), F.col("root").alias("b"), F.col("odd").alias("even"))
    apart = (F.col("a") < F.col("b")) & ((F.col("key") < F.lit(6 << 40)) | (F.col("odd") != F.col("even")))
    more = one.join(two, ["key", "sub"]).where(apart & within("u", "v")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return roots, materialise(components(more), "simhash-more", True)


def chains(docs: DataFrame, size: int = 4, most: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found (doc_id, print, x) and nodes (print, first: its smallest doc_id), both written, and roots (print, root) of the
    fingerprints that links chain together."""
    found = materialise(fingerprints(docs, size), "simhash-prints")
    nodes = materialise(found.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-nodes", True)
    roots, more = linked(nodes, most, rows(nodes) > WIDE)
    return found, nodes, chained(roots, more).withColumnRenamed("node", "print")


def near_groups(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), print, x.

    Null texts count as empty; a text without words has fingerprint zero and is linked like any other; fewer words than a
    shingle has make one shingle. Repeated rows give repeated results; a null doc_id is never the smallest unless its
    whole component has none. An empty table gives an empty result; other columns are not read. A long text is read by one
    worker, AT_ONCE shingles at a time. Rows of equal fingerprint are one node, so copies are never paired.
    """
    found, nodes, roots = chains(docs, size, most)
    groups = materialise(roots.join(nodes, "print"), "simhash-chained")
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    groups = materialise(groups.join(least.hint("merge"), "root").select("print", "least"), "simhash-groups", True)
    ids = nodes.join(merged_if(groups, BROADCAST_ROWS), "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    return found.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "print", "x")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id (of several such, the smallest text
    hash; of rows equal in both, one; null ids last); all columns stay. Nulls, empty and long texts and empty tables as in
    near_groups. Only what goes is shipped to the anti-join."""
    return keep_least(docs, near_groups(docs))


def candidates(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """u, v, written: hashes of two different texts whose fingerprints are linked, each text of a component with its smallest
    one."""
    found, _, roots = chains(docs, size, most)
    roots = merged_if(materialise(roots, "simhash-chained", True), BROADCAST_ROWS)
    named = found.select("print", "x").distinct().join(roots, "print", "left").select("x", F.coalesce("root", "print").alias("root"))
    named = materialise(named, "simhash-texts")
    first = named.groupBy("root").agg(F.min("x").alias("u"), F.max("x").alias("high")).where("u != high").select("root", "u")
    first = merged_if(materialise(first, "simhash-firsts", True), BROADCAST_ROWS)
    return materialise(named.join(first, "root").where("x != u").select("u", F.col("x").alias("v")), "simhash-candidates", True)


def keep_similar(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of five-word shingles at a Jaccard similarity of 0.8 or more, the one with
    the smallest doc_id; all columns stay. Candidates are first the texts that fingerprints link, which the exact similarity
    then has to confirm; as 0.8 is wider than fingerprint bits reach, what is still apart comes from the exact join of
    operator 11 (symgraph.llm.jaccard). Nulls, empty and long texts and empty tables are as in near_groups."""
    from symgraph.llm import jaccard

    return keep_least(docs, jaccard.near_groups(docs, candidates=candidates(docs)))


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one document of each component of groups (doc_id, component_id, x), as keep_one says."""
    found = materialise(groups, "near-groups")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "x")).alias("best"), F.count(F.lit(1)).alias("n"))
    several = found.alias("f").join(best.where("n > 1").alias("b"), F.expr("f.component_id <=> b.component_id"))
    stays = F.expr("f.doc_id <=> if(b.best.none, null, b.best.doc_id) and f.x = b.best.x")
    mark = several.groupBy(F.col("f.doc_id").alias("doc_id"), F.col("f.x").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays"))
    return without(docs, mark.where("n > 1 or not stays"))
