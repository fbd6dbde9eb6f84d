"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

Counts of terms are laid out as tiles: a block of a language's kept terms by a block of its sources, each tile a dense int64
matrix in one task. A task turns two blocks of sources into probabilities in parts of a thousand million, broadcasts every
pair of rows over the block of terms and sums; partial matrices of pairs are summed over the blocks, and each group's
best terms of a tile, a heap, are merged. All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches
from symgraph.session import broadcast_if, materialise

#: Of each byte: letters stay, A-Z lower-cased, and what is not ASCII; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
#: Terms and sources of a tile, about.
TERMS, SOURCES = 1024, 64
#: Counts that a worker holds before it gives them out, and bytes that it takes at a time.
HELD, PIECE = 200_000, 1 << 20
BROADCAST_ROWS = 300_000
SCALE = 3  # steps of a thousand


def terms(text: bytes):
    """Lists of the text's terms, in order; long texts give several lists."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        rest = text[at:end].translate(LETTERS)
        while end < len(text) and not rest.endswith(b" "):
            more = text[end : end + PIECE].translate(LETTERS)
            cut = more.find(b" ") + 1 or len(more)
            rest += more[:cut]
            end += cut
        yield rest.split()
        at = end


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term); and a row with a null term for each group."""

    def run(batches):
        used, had, held = {}, {}, 0

        def given():
            keys = [(g, t) for g, c in used.items() for t in c]
            columns = [pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()), pa.array([None if t is None else t.decode() for _, t in keys], pa.string())]
            columns += [pa.array([by[g][t] for g, t in keys], pa.int64()) for by in (used, had)]
            used.clear()
            had.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for *group, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                group = tuple(group)
                if group not in used:
                    used[group], had[group] = Counter({None: 0}), Counter({None: 0})
                here, before = set(), len(used[group])
                for some in terms(text.as_py()):
                    used[group].update(some)
                    here.update(some)
                had[group].update(here)
                held += len(used[group]) - before
                if held >= HELD:
                    held = 0
                    yield given()
        if used:
            yield given()

    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = in_batches(some.withColumn("text", F.col("text").cast("binary"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (n + 2) / total) for total of at least n + 2, digit by digit, so that nothing exceeds 63 bits."""
    rest, out = n + 2, np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(SCALE):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + whole * 1000**SCALE + out


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def tile(best: int):
    """The function of one tile: rows of groups (term null; n their kept occurrences, total the language's, v the language's
    kept terms, here those in this block) and of counts (term, n, total of the language) in two blocks of sources."""

    def run(table: pa.Table) -> pa.Table:
        lang, s1, s2 = (table.column(c)[0].as_py() for c in ("lang", "s1", "s2"))
        d = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "total", "v", "here", "s")}
        names, words = table.column("source").to_pylist(), table.column("term").to_pylist()
        group = np.array([t is None for t in words], bool)
        first = np.flatnonzero(group)[0]
        v, here, whole = (int(d[c][first]) for c in ("v", "here", "total"))
        row_of = {names[i]: k for k, i in enumerate(np.flatnonzero(group))}
        sums, block = d["n"][group].astype(np.int64), d["s"][group]
        labels, at = list(row_of), {}
        for i in np.flatnonzero(~group):
            at.setdefault(words[i], len(at))
        dense, total = np.zeros((len(labels), len(at)), np.int64), np.zeros(len(at), np.int64)
        for i in np.flatnonzero(~group):
            dense[row_of[names[i]], at[words[i]]], total[at[words[i]]] = d["n"][i], d["total"][i]
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value")}

        def put(*values):
            for c, x in zip(out, values, strict=True):
                out[c].append(x)

        p = shares(dense, (sums + 2 * v)[:, None]) if len(at) else np.zeros((len(labels), 0), np.int64)
        unseen = shares(np.zeros(len(labels), np.int64), np.maximum(sums + 2 * v, 2))
        left, right = np.flatnonzero(block == s1), np.flatnonzero(block == s2)
        for i in left:  # one row of pairs at a time: (right, terms)
            values = far(p[i][None, :], p[right]).sum(1) + (here - len(at)) * far(unseen[i], unseen[right])
            for j, x in zip(right.tolist(), values.tolist(), strict=True):
                if i != j:
                    put(labels[i], "pair", labels[j], x)
                    if s1 != s2:
                        put(labels[j], "pair", labels[i], x)
        if s1 == s2 and len(at):
            q, items = shares(total, np.array(whole + 2 * v)), list(at)
            for i in left:
                ahead = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = far(p[i][ahead], q[ahead])
                heap = heapq.nsmallest(best, ((-x, items[t].encode()) for x, t in zip(value.tolist(), ahead.tolist(), strict=True)))
                for x, item in heap:
                    put(labels[i], "term", item.decode(), -x)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({"lang": pa.array([lang] * len(out["part"]), pa.string())} | {c: pa.array(x, kind) for (c, x), kind in zip(out.items(), kinds, strict=True)})

    return run


def audit(docs: DataFrame, least: int = 10, best: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text).

    Part pair has every other source of the language, by the divergence of all kept terms' shares; part term the best terms
    that a source uses more than its language. A language keeps the terms in at least so many of its rows. Nulls in the three
    columns count as ''; groups without terms take part; a language without kept terms has pairs of value 0; repeated rows
    count again; a language with one source has no pairs; long texts are read in pieces; an empty table gives an empty
    result; other columns are not read.

    Counts are added up in tasks before they are shuffled, so a hot source is a row a term and task. Rows of the result
    grow with the square of a language's sources, as pairs of all ranks are asked for.
    """
    counted = materialise(counts(docs), "divergence-counts")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = materialise(kept, "divergence-kept", True)
    some = materialise(counted.join(broadcast_if(kept, BROADCAST_ROWS), ["lang", "term"]).select("lang", "source", "term", "n", "total"), "divergence-some")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total"))
    sums = some.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = materialise(counted.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "divergence-groups", True)
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left").na.fill(0, ["v", "total"])
    sizes = sizes.withColumn("blocks", F.expr(f"greatest(1, (v + {TERMS - 1}) div {TERMS})")).withColumn("parts", F.expr(f"(sources + {SOURCES - 1}) div {SOURCES}"))
    sizes = broadcast_if(materialise(sizes, "divergence-sizes", True), BROADCAST_ROWS)
    in_block, in_part = F.expr("pmod(xxhash64(term), blocks)").alias("block"), F.expr("pmod(xxhash64(source), parts)").alias("s")
    here = kept.join(sizes.select("lang", "blocks"), "lang").select("lang", in_block).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("here"))
    others = F.explode(F.expr("transform(sequence(0L, parts - 1), t -> struct(least(s, t) as s1, greatest(s, t) as s2))")).alias("to")
    ranged = groups.join(sizes, "lang").select("lang", "source", "n", "total", "v", "parts", in_part, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    heads = ranged.join(here, ["lang", "block"], "left").na.fill(0, ["here"]).select("lang", "block", "source", F.lit(None).cast("string").alias("term"), "n", "total", "v", "here", "s", others)
    nothing = F.lit(0).cast("long")
    cells = some.join(sizes.select("lang", "blocks", "parts"), "lang").select("lang", in_block, "source", "term", "n", "total", nothing.alias("v"), nothing.alias("here"), in_part, "parts")
    cells = cells.select("lang", "block", "source", "term", "n", "total", "v", "here", "s", others)
    tiles = heads.unionByName(cells).select("*", "to.s1", "to.s2").drop("to").groupBy("lang", "block", "s1", "s2")
    made = materialise(tiles.applyInArrow(tile(best), "lang string, source string, part string, item string, value long"), "divergence-tiles")
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(ordered))
    return ranked.unionByName(made.where("part = 'term'").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= best))


#: For DuckDB: the whole grid of groups by kept terms, and all its pairs.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d), kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL), groups AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
sums AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS nn FROM groups g LEFT JOIN c USING (lang, source) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (nn + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (size.total + 2 * v) AS q
 FROM sums g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM grid WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""
