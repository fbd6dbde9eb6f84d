import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import divergence


def brute(rows, least=10, best=10):
    used, had = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        used[lang or "", source or ""].update(found)
        had[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in used}:
        kept, groups = [t for t, n in had[lang].items() if n >= least], [g for g in used if g[0] == lang]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {g: share(used[g]) for g in groups}, share(sum((used[g] for g in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = sorted(((-sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in groups if h != g), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[g][t], q[t]), t) for t in kept if used[g][t] and p[g][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:best]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(*g, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def planted(sources, langs=("en", "fr", None), rows=400):
    rng = random.Random(sources)
    words = [f"{a}{b}" for a in ("Term", "Été", "x", "中", "\U0001f600") for b in "abcdefghij"]
    made = [(rng.choice(langs), rng.choice([None, *(f"s{i}" for i in range(sources))]), " ".join(rng.choices(words[: rng.randint(3, 50)], k=rng.randint(0, 30))) + "1_2") for _ in range(rows)]
    return made + [("en", "nothing", None), ("en", "nothing", ""), ("lone", "only", "a a"), ("none", "one", "rare"), ("none", "two", "")]


@pytest.mark.parametrize("terms, sources, n", [(1024, 64, 6), (7, 2, 6), (16, 64, 1)])
def test_equals_brute_force(spark, monkeypatch, terms, sources, n):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rows = planted(n)
    got = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and ("none", "one", "pair", "two", 0, 1) in want


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randint(3, 10 ** rng.randint(1, 15))
        n = rng.randint(0, total - 2)
        assert divergence.shares(np.array([n]), np.array([total])).tolist() == [1 + 10**9 * (n + 2) // total]


def test_long_texts_in_pieces(monkeypatch):
    text = "One Été,two" * 5
    whole = [t for some in divergence.terms(text.encode()) for t in some]
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert [t for some in divergence.terms(text.encode()) for t in some] == whole


def test_empty_tables_and_clashing_columns(spark):
    rows = [("en", f"s{i % 2}", "same words here", "x") for i in range(12)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, term string").withColumn("n", F.lit("clash"))
    assert sorted(map(tuple, divergence.audit(docs).collect())) == brute([r[:3] for r in rows])
    assert divergence.audit(docs.where("false")).collect() == []
