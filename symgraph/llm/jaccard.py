"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough are linked, and links chained to components.

The sets are the rows of a sparse incidence matrix of documents by n-grams, and overlaps are its product with its own
transpose, taken block by block, with pairs discarded by what their sizes need in common:

1. Columns are cut into blocks by their hash. A task per block of columns sees which n-grams occur in more than one document
   and counts them for each document. A document that shares less than 4/5 of its set with all others together has no
   partner and goes; that is most of a corpus.
2. Of what is left, n-grams are ordered from rare to frequent. Two partners of sizes a and b have 4/9 (a + b) in common, at
   least 4/5 of either, so they meet in one of a document's n - ceil(4n/5) + 1 rarest n-grams. Only these columns pair
   documents.
3. Members of a column are held against two of them; most groups become one component by that. Pairs of different components
   are made in columns of up to CROWD members. In larger ones documents are put into blocks of rows, and each two blocks
   that meet anywhere are multiplied once, in a task of its own, which adds up overlaps over parts of the columns, drops
   pairs that can't reach their bound any more and gives a forest of the links rather than all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, rows_of, text_of
from symgraph.llm.components import BROADCAST_ROWS, chained, components
from symgraph.session import broadcast_if, materialise, merged_if, rows

#: Hashes of a block of columns and of a worker's block of rows, about.
COLUMN, HELD = 1 << 21, 1 << 19
#: Members of a column up to which pairs are made; documents of a block of rows; n-grams that are multiplied at a time.
CROWD, ROWS, AT_ONCE = 64, 256, 1 << 16
#: Times BROADCAST_ROWS that are broadcast to the texts, which are long to shuffle; twice in a job.
TO_TEXTS = 10


def grams(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of size words, or of all words if there are fewer; none without."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    del words
    found = np.fromiter((hashed(joined[a:b]) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique(found)


def tiles(size: int, bits: int):
    """A mapInArrow function over x, text: for each of 2^bits blocks of columns and each worker's block of documents, the
    places of the documents that have n-grams there (at), how many others of the block have too (both) and how many they
    alone have (alone, whose hashes follow in hashes), and the hashes (once) of those that several have (known). The first
    block of columns also has the documents' names and sizes (x, n)."""

    def run(batches):
        x, found, held = [], [], 0

        def given():
            n = np.array(list(map(len, found)), np.int64)
            every, of = np.concatenate(found) if found else np.empty(0, np.uint64), np.repeat(np.arange(len(n)), n)
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            same = ordered[1:] == ordered[:-1]
            several = np.zeros(len(every), bool)
            several[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(every) else False
            known = np.unique(every[several])
            column, column_known = (h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64) for h in (every, known))
            short, short_known = (((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32) for h in (every, known))
            names = np.array(x, np.int64)
            block = xxhash.xxh64_intdigest(names.tobytes()) >> 1
            for c in sorted({0} | set(np.unique(column).tolist())):
                here = column == c
                both, alone = (np.bincount(of[here & m], minlength=len(n)) for m in (several, ~several))
                some = np.flatnonzero(both + alone > 0)
                values = [[block], [c], [None if c else names], [None if c else n], [some], [both[some]], [alone[some]], [short[here & ~several].tobytes()], [short_known[column_known == c].tobytes()]]
                kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "c", "x", "n", "at", "both", "alone", "hashes", "known"])
            x.clear()
            found.clear()

        for b in batches:
            names = b.column(0).to_pylist()
            for i, text in rows_of(b, "text"):
                x.append(names[i])
                found.append(grams(text, size))
                held += len(found[-1]) + 100
                if held >= HELD:
                    held = 0
                    yield from given()
        if x:
            yield from given()

    return run


TILE = "block long, c long, x array<long>, n array<long>, at array<long>, both array<long>, alone array<long>, hashes binary, known binary"
COUNTED = "block long, x array<long>, n array<long>, at array<long>, shared array<long>"


def shared_here(table: pa.Table) -> pa.Table:
    """Of a block of columns, a row for each block of documents: the places of those that have n-grams in it which any other
    document has, and how many; names and sizes are passed on."""
    alone = [np.frombuffer(h.as_py(), np.uint32) for h in table.column("hashes")]
    every = np.sort(np.concatenate([*alone, *[np.frombuffer(h.as_py(), np.uint32) for h in table.column("known")]]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    places, shares = [], []
    for i, hashes in enumerate(alone):
        at, both, counts = (np.asarray(table.column(c)[i].values) for c in ("at", "both", "alone"))
        found = np.searchsorted(twice, hashes)
        hit = np.concatenate([[0], np.cumsum(twice[np.minimum(found, len(twice) - 1)] == hashes)]) if len(twice) else np.zeros(len(hashes) + 1, np.int64)
        ends = np.cumsum(counts)
        shared = both + hit[ends] - hit[ends - counts]
        places.append(at[shared > 0])
        shares.append(shared[shared > 0])
    longs = pa.list_(pa.int64())
    return pa.table({"block": table.column("block"), "x": table.column("x"), "n": table.column("n"), "at": pa.array(places, longs), "shared": pa.array(shares, longs)})


def shared_of(table: pa.Table) -> pa.Table:
    """Of a block of documents: x, n, shared of each, added up over the blocks of columns."""
    named = next(i for i in range(table.num_rows) if table.column("x")[i].is_valid)
    x, n = (np.asarray(table.column(c)[named].values) for c in ("x", "n"))
    shared = np.zeros(len(x), np.int64)
    for i in range(table.num_rows):
        shared[np.asarray(table.column("at")[i].values)] += np.asarray(table.column("shared")[i].values)
    return pa.table({"x": pa.array(x, pa.int64()), "n": pa.array(n, pa.int64()), "shared": pa.array(shared)})


def sets(size: int):
    """A mapInArrow function over x, text: x, n, found (the set's hashes)."""

    def run(batches):
        x, found, held = [], [], 0

        def given():
            columns = [pa.array(x, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            x.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["x", "n", "found"])

        for b in batches:
            names = b.column(0).to_pylist()
            for i, text in rows_of(b, "text"):
                x.append(names[i])
                found.append(grams(text, size).view(np.int64))
                held += len(found[-1]) + 100
                if held >= HELD:
                    held = 0
                    yield given()
        if x:
            yield given()

    return run


def alike(a: Column, b: Column) -> Column:
    """Whether sizes allow a similarity of 4/5."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def verified(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (u, v and others) whose overlap reaches 4/9 of their sizes' sum."""
    pairs = materialise(pairs, "jaccard-pairs", True)
    wanted = materialise(pairs.select(F.col("u").alias("x")).distinct().unionByName(pairs.select(F.col("v").alias("x")).distinct()).distinct(), "jaccard-verify", True)
    some = known.select("x", "n", "found").join(merged_if(wanted, BROADCAST_ROWS), "x", "left_semi")
    one, two = (some.select(F.col("x").alias(x), F.col("n").alias(n), F.col("found").alias(f)) for x, n, f in (("u", "n1", "found1"), ("v", "n2", "found2")))
    both = one.join(merged_if(pairs, BROADCAST_ROWS), "u").join(two, "v")
    return both.where(F.size(F.array_intersect("found1", "found2")) * 9 >= (F.col("n1") + F.col("n2")) * 4).select(pairs.columns)


def product(table: pa.Table) -> pa.Table:
    """a, b: a forest of the links between the components (root) of two blocks of rows, one and two (equal ones: within one).

    Overlaps are added up over parts of the common n-grams; after each part, pairs go whose overlap so far and whatever the
    rest can add are less than their sizes need.
    """
    side = np.asarray(table.column("side"))
    root, n = np.asarray(table.column("root")), np.asarray(table.column("n"))
    one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: both
    found = {i: np.asarray(table.column("found")[int(i)].values).view(np.uint64) for i in range(len(side))}
    count, total = np.zeros((len(one), len(two)), np.int64), n[one][:, None] + n[two][None, :]
    open_ = (root[one][:, None] != root[two][None, :]) & (np.minimum(n[one][:, None], n[two][None, :]) * 5 >= np.maximum(n[one][:, None], n[two][None, :]) * 4)
    flat = [(np.concatenate([found[i] for i in s]), np.repeat(np.arange(len(s)), n[s])) for s in (one, two)]
    (g1, r1), (g2, r2) = ((g[o], r[o]) for g, r in flat for o in [np.argsort(g, kind="stable")])
    common = np.intersect1d(g1, g2)
    for at in range(0, len(common), AT_ONCE):
        if not open_.any():
            break
        part = common[at : at + AT_ONCE]
        low1, high1, low2, high2 = (np.searchsorted(g, part, s) for g in (g1, g2) for s in ("left", "right"))
        for a, b, c, d in zip(low1.tolist(), high1.tolist(), low2.tolist(), high2.tolist(), strict=True):
            count[np.ix_(r1[a:b], r2[c:d])] += 1
        seen1, seen2 = (np.bincount(r[: np.searchsorted(g, part[-1], "right")], minlength=len(s)) for g, r, s in ((g1, r1, one), (g2, r2, two)))
        rest = np.minimum((n[one] - seen1)[:, None], (n[two] - seen2)[None, :])
        open_ &= (count + rest) * 9 >= total * 4
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = i = parent.get(parent[i], parent[i])
        return i

    out = []
    for i, j in zip(*np.nonzero(open_ & (count * 9 >= total * 4)), strict=True):
        a, b = top(int(root[one[i]])), top(int(root[two[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(root[one[i]]), int(root[two[j]])))
    return pa.table({"u": pa.array([min(p) for p in out], pa.int64()), "v": pa.array([max(p) for p in out], pa.int64())})


def crowded_links(known: DataFrame, members: DataFrame) -> DataFrame:
    """u, v: links between the components of members (gram, x, n, root) of large columns.

    Each document is put into a block of rows: the largest of its columns, its size to within a quarter, and the hash of x
    over so many blocks that each has some ROWS rows. Blocks that meet in a column are multiplied once, however many columns they meet
    in; two that are wholly in one component, and sizes too far apart, are left out. Only names of blocks are paired.
    """
    sizes = members.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    placed = members.join(sizes, "gram").groupBy("x").agg(F.max(F.struct("m", "gram")).alias("home"), F.first("n").alias("n"), F.first("root").alias("root"))
    placed = placed.select("x", "n", "root", F.col("home.gram").alias("home"), level.alias("level"))
    shares = placed.groupBy("home", "level").agg(F.expr(f"(count(1) + {ROWS - 1}) div {ROWS}").alias("parts"))
    block = F.xxhash64("home", "level", F.expr("pmod(xxhash64(x), parts)"))
    placed = materialise(placed.join(shares, ["home", "level"]).select("x", "n", "root", "level", block.alias("block")), "jaccard-placed", True)
    blocks = placed.groupBy("block").agg(F.first("level").alias("level"), F.min("root").alias("low"), F.max("root").alias("high"))
    there = members.select("gram", "x").join(merged_if(placed.select("x", "block"), BROADCAST_ROWS), "x").select("gram", "block").distinct()
    there = materialise(there.join(blocks, "block"), "jaccard-blocks")
    one, two = (there.select("gram", *[F.col(c).alias(c + e) for c in ("block", "level", "low", "high")]) for e in "12")
    apart = ~((F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2")))
    pairs = one.join(two, "gram").where((F.col("block1") <= F.col("block2")) & (F.abs(F.col("level1") - F.col("level2")) <= 1) & apart).select("block1", "block2").distinct()
    pairs = materialise(pairs, "jaccard-products", True)
    ends = F.when(F.col("block1") == F.col("block2"), F.array(F.struct(F.col("block1").alias("block"), F.lit(0).alias("side"))))
    ends = ends.otherwise(F.array(F.struct(F.col("block1").alias("block"), F.lit(1).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(2).alias("side"))))
    dealt = pairs.select("block1", "block2", F.inline(ends)).join(placed.select("x", "root", "block"), "block")
    return dealt.join(known.select("x", "n", "found"), "x").groupBy("block1", "block2").applyInArrow(product, "u long, v long")


def linked(docs: DataFrame, size: int = 5, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """named (doc_id, text, x: the text's hash), nodes (x, first: its smallest doc_id), seen (x, n: its set's size) and ids (node,
    root) of the texts that links chain together, all but named written. candidates (u, v: hashes of two texts), if any, are
    verified first, with the hubs."""
    named = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("x", F.xxhash64("text"))
    nodes = materialise(named.groupBy("x").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times"), F.max(F.octet_length("text")).alias("bytes")), "jaccard-nodes", True)
    copied = broadcast_if(materialise(nodes.where("times > 1").select("x", "first"), "jaccard-copied", True), TO_TEXTS * BROADCAST_ROWS)
    texts = named.join(copied, "x", "left").where("first is null or doc_id = first").select("x", "text")
    total = nodes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(32, max(0, int(np.ceil(np.log2(max(1, total / 6 / COLUMN))))))
    tiled = in_batches(texts).mapInArrow(tiles(size, bits), TILE).groupBy("c").applyInArrow(shared_here, COUNTED)
    seen = tiled.groupBy("block").applyInArrow(shared_of, "x long, n long, shared long")
    seen = materialise(seen.groupBy("x").agg(F.max("n").alias("n"), F.max("shared").alias("shared")), "jaccard-shared")
    some = materialise(seen.where("n > 0 and shared * 5 >= n * 4").select("x"), "jaccard-some", True)
    known = in_batches(texts.join(broadcast_if(some, TO_TEXTS * BROADCAST_ROWS), "x", "left_semi")).mapInArrow(sets(size), "x long, n long, found array<long>")
    known = materialise(known.dropDuplicates(["x"]), "jaccard-sets")
    # the rarest n-grams of each document
    cells = known.select("x", "n", F.explode("found").alias("gram"))
    often = materialise(cells.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "jaccard-often", True)
    ranked = cells.join(merged_if(often, BROADCAST_ROWS), "gram").groupBy("x").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("cells"))
    first = F.expr("cast(greatest(0, n - (n * 4 + 4) div 5 + 1 - (n - size(cells))) as int)")
    rare = materialise(ranked.select("x", "n", F.explode(F.slice("cells", F.lit(1), first)).alias("cell")).select("cell.gram", "x", "n"), "jaccard-rare")
    # each column's members against two of them
    member = F.struct("x", "n")
    hubs = rare.groupBy("gram").agg(F.min(member).alias("a"), F.max(member).alias("b")).where("a.x != b.x").select("gram", F.array("a", "b").alias("hubs"))
    stars = rare.join(merged_if(materialise(hubs, "jaccard-hubs", True), BROADCAST_ROWS), "gram").select(F.col("x").alias("u"), F.col("n").alias("n1"), F.inline("hubs")).toDF("u", "n1", "v", "n2").where((F.col("u") != F.col("v")) & alike(F.col("n1"), F.col("n2")))
    stars = stars.select("u", "v") if candidates is None else stars.select("u", "v").unionByName(candidates)
    roots = materialise(components(verified(known, stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())), "jaccard-roots", True)
    # what is still apart
    rooted = materialise(rare.join(merged_if(roots, BROADCAST_ROWS), F.col("x") == F.col("node"), "left").select("gram", "x", "n", F.coalesce("root", "x").alias("root")), "jaccard-rooted")
    mixed = rooted.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m")).where("a != b").select("gram", "m")
    mixed = materialise(mixed, "jaccard-mixed", True)
    few = rooted.join(merged_if(mixed.where(F.col("m") <= CROWD).select("gram"), BROADCAST_ROWS), "gram", "left_semi")
    crowd = materialise(rooted.join(merged_if(mixed.where(F.col("m") > CROWD).select("gram"), BROADCAST_ROWS), "gram", "left_semi"), "jaccard-crowd", True)
    one, two = (few.select("gram", *[F.col(c).alias(c + e) for c in ("x", "n", "root")]) for e in "12")
    pairs = one.join(two, "gram").where((F.col("x1") < F.col("x2")) & (F.col("root1") != F.col("root2")) & alike(F.col("n1"), F.col("n2")))
    links = verified(known, pairs.select(F.col("x1").alias("u"), F.col("x2").alias("v"), F.col("root1").alias("a"), F.col("root2").alias("b")).distinct()).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if rows(crowd):
        links = links.unionByName(crowded_links(known, crowd))
    more = materialise(components(links), "jaccard-more", True)
    return named, nodes, seen, materialise(chained(roots, more), "jaccard-chained")


def joined(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable, itself included).

    Documents link when 100 * intersection >= 80 * union of their sets of size-word shingles, A-Z lower-cased, words as
    between ASCII spaces; fewer words are one shingle. Null and empty texts and those without words have no shingle and link
    with nothing. Equal texts are one node; repeated rows give repeated results; a null doc_id is never the smallest unless
    its whole component has none; an empty table gives an empty result; other columns are not read. A long text is read by
    one worker, which holds its hashes.
    """
    named, nodes, seen, ids = linked(docs, size)
    groups = ids.withColumnRenamed("node", "x").join(nodes.select("x", "first"), "x")
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    groups = groups.join(least, "root").select("x", "least")
    found = materialise(seen.select("x", "n").join(groups, "x", "left"), "jaccard-groups", True)
    out = named.select("doc_id", "x").join(merged_if(found, BROADCAST_ROWS), "x")
    smallest = F.when(F.col("n") > 0, F.coalesce("least", "first", "doc_id"))
    return out.join(merged_if(nodes.select("x", "first"), BROADCAST_ROWS), "x").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(smallest, "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, size: int = 5, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id, x for each row of docs, for deduplication: as joined(), but a component is named by a number of
    its own, and texts without words are one component."""
    named, _, seen, ids = linked(docs, size, candidates)
    roots = seen.select("x", "n").join(ids.withColumnRenamed("node", "x"), "x", "left")
    roots = materialise(roots.select("x", F.when(F.col("n") > 0, F.coalesce("root", "x")).otherwise(0).alias("component_id")), "jaccard-named", True)
    return named.select("doc_id", "x").join(merged_if(roots, BROADCAST_ROWS), "x").select("doc_id", "component_id", "x")


#: For DuckDB: all pairs that share a shingle, and the smallest doc_id carried along the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 180 * c >= 80 * (a.n + b.n)),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.v, r.root FROM r JOIN links l ON l.u = r.node WHERE r.root < l.v)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node
"""
