import hashlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symgraph.llm import exact, golay, simhash
from symgraph.llm.components import components

SCHEMA = "doc_id long, text string, source string, n long, print string, x int, key int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "clash", 2, 3) for i, t in texts], SCHEMA)


TEXTS = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, " \t"), (7, LONG), (8, LONG), (None, "a b c d e f"), (9, LONG[:-1] + "x"), (10, "é ü")]


def brute_groups(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("prime", [exact.PRIME, 3])
def test_exact_groups_match_brute_force_even_when_fingerprints_collide(spark, prime):
    want = brute_groups(TEXTS)
    got = exact.exact_groups(frame(spark, TEXTS), prime).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        ids = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_empty_table_and_stage(spark):
    assert exact.exact_groups(frame(spark, [])).count() == 0
    docs = frame(spark, TEXTS)
    left = exact.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in left.collect()) == sorted((t, max(i for i in v if i is not None)) for t, v in brute_groups(TEXTS).items())


def test_fingerprints_compose():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    for base in exact.BASES:
        a, b = np.frombuffer(data[:40_000], np.uint8), np.frombuffer(data[40_000:65_000], np.uint8)
        both = np.frombuffer(data[:65_000], np.uint8)
        assert exact.combine(exact.chunk_hash(a, base), exact.chunk_hash(b, base), len(b), base) == exact.chunk_hash(both, base)
    plain = 0
    for byte in data:
        plain = (plain * exact.BASES[0] + byte) % exact.PRIME
    assert exact.fingerprint(data) >> 31 == plain


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_on_documents(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    base = rows[3][1]
    near = [(1000 + i, base.replace(" ", f" w{i} ", 1 + i % 3)) for i in range(40)]
    rows += near + [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE  two"), (2004, LONG)]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    want = sorted((d, f"{p:016x}", min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i])) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(frame(spark, rows)).collect())
    assert got == want
    left = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("crowd", [64, 1])
@pytest.mark.parametrize("wide", [False, True])
def test_simhash_links_random_neighbours_and_chains(spark, monkeypatch, wide, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    prints = []
    for s in seeds:
        p = s
        for _ in range(6):  # a chain whose ends are far apart
            prints.append(int(p))
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= np.uint64(1) << np.uint64(b)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    first, more = simhash.linked(spark.createDataFrame([(p,) for p in signed], "print long"), wide=wide)
    last = {r.node: r.root for r in more.collect()}
    root = {p: last.get(p, p) for p in signed} | {r.node: last.get(r.root, r.root) for r in first.collect()}
    want = brute_components(prints)
    got = {}
    for p, w in zip(signed, want, strict=True):
        got.setdefault(w, set()).add(root.get(p, p))
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(got)


@pytest.mark.parametrize("wide", [False, True])
def test_four_errors_share_a_key_of_both_parities(wide):
    rng = np.random.default_rng(11)
    p = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    q = p.copy()
    for _ in range(4):
        q ^= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    a, b = set(zip(*simhash.keys_of(p, wide), strict=True)), set(zip(*simhash.keys_of(q, wide), strict=True))
    good = set()
    for i, k in a & b:
        kind = int(k) >> 40
        if kind >= 6:
            low, bits = simhash.SEGMENTS[list(combinations(range(3), 2))[kind - 6][0]]
            mask = np.uint64(((1 << bits) - 1) << low)
            if np.bitwise_count(p[i] & mask) % 2 == np.bitwise_count(q[i] & mask) % 2:
                continue
        good.add(int(i))
    assert good == set(range(4000))


def test_wide_keys_give_the_same_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = sorted(map(str, simhash.near_groups(docs).collect()))
    monkeypatch.setattr(simhash, "WIDE", 1)
    assert sorted(map(str, simhash.near_groups(docs).collect())) == few


def test_turned_bits_keep_distances():
    p = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    t = simhash.turned(p)
    assert (np.bitwise_count(t[1:] ^ t[:-1]) == np.bitwise_count(p[1:] ^ p[:-1])).all()


def test_simhash_edges(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww vv")])
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(twice).collect()}
    assert got == {(1, 1), (None, 1), (None, None)}
    assert simhash.keep_one(twice).count() == 2


def test_golay_covers_two_errors():
    rng = np.random.default_rng(5)
    errors = golay.tables()[3]
    assert np.bincount(np.bitwise_count(errors)).tolist() == [1, 23, 253, 1771]
    w = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    v = w ^ (np.uint32(1) << rng.integers(0, 23, 3000).astype(np.uint32)) ^ (np.uint32(1) << rng.integers(0, 23, 3000).astype(np.uint32))
    a, b = set(zip(*golay.keys(w), strict=True)), set(zip(*golay.keys(v), strict=True))
    assert {i for i, _ in a & b} == set(range(3000))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600), (600, 601), (601, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 400)}, 600: 600, 601: 600}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")).where(F.col("root") == "a").count() == 3


def test_components_broadcast_nothing_that_grows(spark, monkeypatch):
    from symgraph.llm import components as C

    plans = []
    written = C._written
    monkeypatch.setattr(C, "_written", lambda e: plans.append(e._jdf.queryExecution().executedPlan().toString()) or written(e))
    edges = spark.range(1, 400).selectExpr("id as u", "id div 2 as v")
    assert {(r.node, r.root) for r in C.components(edges).collect()} == {(i, 0) for i in range(400)}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
