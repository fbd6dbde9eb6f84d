import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 1.0, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, target double, copies string")


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by bisection of the level to which weights are filled."""
    total = share * sum(sizes)
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(most * s, lo * w) for s, w in zip(sizes, weights, strict=True)]


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    names = sorted({r.source for r in texts.values()})
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in texts.items()}
    per = {s: sum(size[d] for d, r in texts.items() if r.source == s) for s in names}
    want = dict(zip(names, water([per[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    for s in names:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(want[s], rel=0.002, abs=3)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_edges(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "one two three", None), (3, "one two three", None), (4, "w " * 5000, "a"), (5, "x y", "é"), (None, "p q r s", "a"), (6, "k " * 30, "c")] + [(100 + i, "same size text", "d") for i in range(5000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = ["a", "b", "c", "d", "é", None]
    sizes = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = dict(zip(names, water([sizes[s] for s in names], [3, 1, 2, 3, 1, 2]), strict=True))
    for s in names:
        assert all(r.target == pytest.approx(want[s], abs=1e-6) and r.source_size == sizes[s] for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= max(3, 0.01 * want[s], min([r.size for r in got if r.source == s and r.size] or [0]))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    counts = {(r.doc_id, r.text): r.n for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    taken = {}
    for r in got:
        taken.setdefault(r.doc_id, []).append(r.copies)
    texts = {i: t for i, t, _ in rows}
    for d, copies in taken.items():
        assert counts.get((d, texts[d]), 0) == sum(copies)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.repeated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("goal", [0.02, 0.3, 0.9, 1.5, 1.97])
def test_newton_meets_any_target(spark, goal):
    counts = spark.createDataFrame([("s", z, n) for z, n in ((1, 50), (3, 80), (40, 20), (900, 3), (20_000, 1))] + [("t", 5, 10)], "source string, size long, n long")
    size = 50 + 240 + 800 + 2700 + 20_000
    t = mixing.solve(counts, {"s": (goal * size, size), "t": (100.0, 50)}, size + 50, 164, 1.5, 2)
    rates = [mixing.rate(t["s"], z, 1.5, 2, (size + 50) / 164)[0] for z in (1, 3, 40, 900, 20_000)]
    got = sum(float(r) * z * n for r, z, n in zip(rates, (1, 3, 40, 900, 20_000), (50, 80, 20, 3, 1), strict=True))
    assert got == pytest.approx(goal * size, rel=2e-4) and t["t"] == float("inf")


@pytest.mark.parametrize("goal", [0.3, 0.9, 1.7])
def test_rates_are_nearest_in_entropy(spark, goal):
    """No other rates that meet the target are closer to the common rate: small feasible moves in any direction cost more."""
    sizes, many = np.array([1, 3, 40, 90, 200.0]), np.array([50, 80, 20, 3, 1.0])
    counts = spark.createDataFrame([("s", int(z), int(n)) for z, n in zip(sizes, many, strict=True)], "source string, size long, n long")
    total = float(sizes @ many)
    t = mixing.solve(counts, {"s": (goal * total, total)}, int(total), int(many.sum()), 1.5, 2, near=1e-10)
    rates = mixing.rate(t["s"], sizes, 1.5, 2, total / many.sum())[0]

    def entropy(r):
        p, q = r / 2, 1.5 / 2
        return many @ (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q)))

    rng, room = np.random.default_rng(1), np.minimum(rates, 2 - rates)
    weight = sizes * many * room
    for _ in range(300):
        move = rng.normal(size=5)
        move -= weight * (move @ weight) / (weight @ weight)  # the target stays met
        assert entropy(rates + 0.1 * room * move / np.abs(move).max()) > entropy(rates) - 1e-9
        assert entropy(rates + 0.9 * room * move / np.abs(move).max()) > entropy(rates) - 1e-9


def test_unmet_targets_are_an_error(spark):
    counts = spark.createDataFrame([("s", 3, 10), ("s", 50, 2)], "source string, size long, n long")
    with pytest.raises(RuntimeError, match="1 sources did not meet"):
        mixing.solve(counts, {"s": (70.0, 130)}, 130, 12, 1.5, 2, rounds=1)
