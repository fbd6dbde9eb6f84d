import random
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symgraph.llm import jaccard
from symgraph.session import table


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    found, ids = [shingles_of(t) for _, t in rows], {}
    for s in found:
        ids.setdefault(s, len(ids))
    sets, root, post = list(ids), list(range(len(ids))), defaultdict(list)

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, s in enumerate(sets):
        common = Counter(o for g in s for o in post[g])
        for o, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                root[top(o)] = top(k)
        for g in s:
            post[g].append(k)
    least = {}
    for (i, _), s in zip(rows, found, strict=True):
        if s and i is not None:
            least[top(ids[s])] = min(least.get(top(ids[s]), i), i)
    return [(i, len(s), least.get(top(ids[s])) if s else i) for (i, _), s in zip(rows, found, strict=True)]


def planted():
    """Near copies around 0.8, a group of which most are a little less alike, a common passage, chains and short texts."""
    rng, rows = random.Random(3), []
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    for k in range(40):
        base = rng.choices(words, k=rng.randint(40, 300)) + passage * (k % 3 == 0)
        other = base[:]
        for at in rng.sample(range(len(base)), 1 + len(base) * (k % 8) // 120):
            other[at] = "new"
        rows += [(1000 - 2 * k, " ".join(base)), (1001 - 2 * k, "\n".join(other).upper())]
    base = rng.choices(words, k=150)
    for k in range(90):
        other = base[:]
        for at in rng.sample(range(150), 2 + k % 3):
            other[at] = rng.choice(words)
        rows.append((2000 + k, " ".join(other)))
    for k in range(12):
        base = base[3:] + rng.choices(words, k=3)
        rows.append((3000 + k, " ".join(base)))
    return rows + [(1, "one two"), (2, "ONE\ttwo "), (3, "one  three"), (4, ""), (5, None), (6, " \n"), (7, ""), (1, "one two"), (8, "  Été"), (9, "  été")]


@pytest.mark.parametrize("crowd, rows_in_block, column", [(64, 256, 1 << 22), (4, 16, 1 << 8)])
def test_equals_brute_force(spark, monkeypatch, crowd, rows_in_block, column):
    for name, value in (("CROWD", crowd), ("ROWS", rows_in_block), ("COLUMN", column), ("AT_ONCE", 50)):
        monkeypatch.setattr(jaccard, name, value)
    rows = planted()
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(a != c for a, _, c in want) > 60


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, jaccard.joined(docs).collect())) == sorted(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_nulls_empty_tables_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, "a"), (4, text, None), (None, None, "b"), (None, "alone and by itself it is", None), (-3, text + " more", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").withColumns({c: F.lit("clash") for c in ("n", "gram")})
    got = sorted(map(str, (tuple(r) for r in jaccard.joined(docs).collect())))
    assert got == sorted(map(str, [(None, 46, -3), (4, 46, -3), (None, 0, None), (None, 2, None), (-3, 47, -3)]))
    assert jaccard.joined(docs.where("false")).collect() == []


def test_product_drops_pairs_by_their_sizes():
    sets = [list(range(10)), list(range(1, 11)), list(range(5, 15)), list(range(100, 110))]
    made = pa.table({"side": [0] * 4, "x": [0, 1, 2, 3], "root": [10, 11, 12, 13], "n": [10] * 4, "found": pa.array(sets, pa.list_(pa.int64()))})
    assert jaccard.product(made).to_pylist() == [{"u": 10, "v": 11}]


def test_shared_counts(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d e f y"), (3, "q r s t u v")]
    docs = spark.createDataFrame(rows, "x long, text string").repartition(3)
    for bits in (0, 2):
        made = docs.mapInArrow(jaccard.tiles(5, bits), jaccard.TILE).groupBy("c").applyInArrow(jaccard.shared_here, jaccard.COUNTED)
        found = made.groupBy("block").applyInArrow(jaccard.shared_of, "x long, n long, shared long")
        assert sorted(map(tuple, found.collect())) == [(1, 3, 2), (2, 4, 2), (3, 2, 0)]


def test_pairs_to_verify_are_not_broadcast(spark):
    """Of 44,850 pairs none goes to the driver: they are merged with the sets, and each link is found."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = {x: list(range(x, x + 20)) for x in range(300)}
        known = spark.createDataFrame([(x, 20, s) for x, s in sets.items()], "x long, n long, found array<long>")
        pairs = spark.createDataFrame(list(combinations(sets, 2)), "u long, v long")
        links = jaccard.verified(known, pairs)
        assert "Inner, Build" not in links._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in links.collect()} == {(a, b) for a, b in combinations(sets, 2) if b - a <= 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
