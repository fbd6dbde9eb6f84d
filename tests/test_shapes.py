"""Components, orders, patterns, spans, posting lists and vector lists against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.operators import analysis, graph, intervals, retrieval, search, vector_index
from symgraph.plans import adapters as A
from symgraph.session import table


def edges(spark, pairs, kind="Calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source_id long, target_id long, kind string")


def reach(pairs):
    out = {a: set() for p in pairs for a in p}
    for a, b in pairs:
        out[a].add(b)
    full = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        full[n] = seen
    return full


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 9), (5, 9), (7, 8)] if seed is None else list({(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    far = reach(pairs)
    want = {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}
    got = {r.node: r.component for r in graph.strong_components(edges(spark, pairs)).collect()}
    assert got == want and (seed is not None or got == {1: 1, 2: 1, 4: 4, 5: 4, 9: 9})


def test_strong_components_of_nothing(spark):
    assert graph.strong_components(edges(spark, [])).collect() == [] == graph.strong_components(edges(spark, [(1, 2), (2, 3)])).collect()


def test_forest_order(spark):
    rng = random.Random(4)
    up = {i: rng.choice([None, *range(max(0, i - 6), i)]) if i % 9 else None for i in range(60)}
    up |= {100 + i: 100 + i - 1 if i else None for i in range(30)}
    below = {n: sorted(c for c, p in up.items() if p == n) for n in [None, *up]}
    want, pre, post = {}, iter(range(1000)), iter(range(1000))

    def walk(n, depth):
        first = next(pre)
        sizes = [walk(c, depth + 1) for c in below[n]]
        want[n] = (depth, first, next(post), 1 + sum(sizes))
        return want[n][3]

    for r in below[None]:
        walk(r, 0)
    rows = spark.createDataFrame(list(up.items()), "node long, parent long")
    got = {r.node: (r.depth, r.pre, r.post, r["size"]) for r in graph.forest_order(rows, rows.select("node")).collect()}
    assert got == want


def test_forests_only(spark):
    for pairs in ([(1, 2), (1, 3)], [(1, 2), (2, 1)]):
        with pytest.raises(ValueError):
            graph.forest_sizes(spark.createDataFrame(pairs, "node long, parent long"))
    e, seeds = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 4)], "Inherits"), spark.createDataFrame([(4,), (2,), (1,)], "seed long")
    assert {r.seed: r.n for r in graph.count_below(e, seeds).collect()} == {4: 4, 2: 1}
    assert {r.seed: r.n for r in graph.count_below(edges(spark, [(1, 2), (2, 4), (3, 4)]), seeds).collect()} == {4: 3, 2: 1}


def test_triangles_and_patterns(spark):
    rng = random.Random(6)
    pairs = list({(rng.randrange(25), rng.randrange(25)) for _ in range(110)})
    e, both = edges(spark, pairs), {frozenset(p) for p in pairs}
    want = sorted(c for c in combinations(range(25), 3) if all(frozenset(p) in both for p in combinations(c, 2)))
    assert sorted(map(tuple, graph.triangles(e).collect())) == want and len(want) > 5
    nodes = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(25)], "id long, kind string")
    some = set(pairs)
    got = graph.match_graph(nodes, e, {"a": "even", "b": None, "c": "odd", "d": None}, [("a", "Calls", "b"), ("b", "Calls", "c"), ("c", "Calls", "a"), ("d", "Calls", "b")], {"b": "id > 2"})
    want = [(a, b, c, d) for a, b in some for c in range(25) for d in range(25) if a % 2 == 0 and c % 2 and b > 2 and (b, c) in some and (c, a) in some and (d, b) in some and len({a, b, c, d}) == 4]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        graph.match_graph(nodes, e, {"a": None, "b": None, "c": None, "d": None}, [("a", "Calls", "b"), ("c", "Calls", "d")])


def test_enclosing_spans(spark):
    rng = random.Random(8)
    spans = []
    for i in range(300):
        start = rng.randrange(5_000)
        spans.append((rng.choice("fg"), f"s{i}", start, start + rng.choice([-1, 0, 3, 15, 16, 200, 4_000])))
    spans += [("h", None, 1, 2), ("f", "none", None, 5)]
    places = [(rng.choice("fgh"), rng.randrange(5_200), k) for k in range(400)] + [("f", None, 1), ("f", 7, 900), ("f", 7, 900)]
    s, p = spark.createDataFrame(spans, "file_path string, id string, start int, end int"), spark.createDataFrame(places, "file_path string, line int, tag int")
    hits = {(f, line): [(b - a, -a, i, a, b) for g, i, a, b in spans if a is not None and g == f and a <= line <= b] for f, line, _ in places if line is not None}
    want = {(*x, min(h)[2:]) for x, h in ((x, hits.get(x[:2], [])) for x in places) if h and x[0] != "h"}
    got = {(r.file_path, r.line, r.tag, (r.id, r.start, r.end)) for r in intervals.enclosing(s, p).where("file_path != 'h'").collect()}
    assert got == want
    assert intervals.enclosing(s, p.where("file_path != 'h'").distinct(), every=True).count() == sum(len(hits.get(x[:2], [])) for x in set(places) if x[0] != "h")


def test_posting_lists_answer_like_a_scan(spark):
    texts = ["The Quick brown", "", None, "a\nthe end\r\nof THE line", "İstanbul straße", "x", "quick quick", "thequick"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("f0", texts[0])], "file_path string, content string")
    queries = ["the", "qu", "e", "quick", "THE LINE", "straße", "zzz", "x", "end", "i", " "]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    want = sorted((x, f"f{i}", n + 1) for x in queries if x.strip() for i, t in [*enumerate(texts), (0, texts[0])] for n, line in enumerate((t or "").replace("\r\n", "\n").split("\n")) if t is not None and x.lower() in line.lower())
    for index in (None, search.text_index(files)):
        got = search.source_text(files, q, None, index=index)
        assert sorted((r.query, r.file_path, r.line) for r in got.collect()) == want
    plan = search.source_text(files, q, None)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert search.source_text(files.where("false"), q, None).collect() == []


def test_posting_lists_are_neither_summed_nor_shuffled(spark, monkeypatch):
    plans, write = {}, search.materialise
    monkeypatch.setattr(search, "materialise", lambda df, name, *more: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name, *more))
    files = spark.createDataFrame([(k % 7, f"some text {k % 7}") for k in range(40)], "_key long, t string")
    got = search.containing(files, F.col("t"), spark.createDataFrame([("text 3",), ("TEXT 3",), ("om",), ("zz",)], "query string"))
    assert sorted(map(tuple, got.collect())) == sorted([("text 3", 3), ("TEXT 3", 3), *[("om", k) for k in range(7)]])
    assert not plans["posting-lists"].startswith("Aggregate")


def test_symbols_are_dealt_evenly(spark):
    sizes = [r[1] for r in A.symbols(spark, "/root/testdata/sf0.01").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_vector_lists_recall(spark):
    d = "/root/testdata/sf0.01"
    v = A.vectors(spark, d)
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.lit("all").alias("collection"), F.col("embedding").alias("target"))
    centres = vector_index.train(v)
    index = vector_index.listed(v.select("collection", "id", "vector"), centres).cache()
    assert index.count() == v.count()
    exact = {(r.query, r.id) for r in retrieval.vector_search(v, asked).collect()}
    recall = lambda probes: len(exact & {(r.query, r.id) for r in vector_index.search(index, centres, asked, probes=probes).collect()}) / len(exact)
    assert recall(None) >= 0.9 and recall(len(centres)) == 1


def test_vector_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 16)
    rng = np.random.default_rng(1)
    rows = [("c", i, rng.normal(size=4).tolist()) for i in range(200)] + [("c", 500, None), ("c", 501, [0.0] * 4), ("other", 1, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "collection string, id long, vector array<float>")
    centres = vector_index.train(v, 3)
    index = vector_index.listed(v, centres).cache()
    asked = v.where("id < 5").select(F.col("id").alias("query"), "collection", F.col("vector").alias("target"))
    got = vector_index.search(index, centres, asked.where("collection = 'c'"), 5, probes=3)
    exact = retrieval.vector_search(v.where("vector is not null and id != 501"), asked.where("collection = 'c'"), 5)
    assert {(r.query, r.id, r.place) for r in got.collect()} == {(r.query, r.id, r.place) for r in exact.collect()}
    assert vector_index.search(vector_index.listed(v.where("false"), centres), centres, asked).collect() == []


def test_health_does_not_warn_of_what_lies_between_cycles(spark):
    nodes = spark.createDataFrame([(i, f"C{i}", "Class", "r1" if i != 3 else "r2") for i in range(1, 6)], "id long, label string, kind string, repository string")
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)], "Inherits").withColumn("repository", F.lit("r1"))
    symbols = nodes.select(F.col("id"), F.col("label").alias("name"), F.lit("Type").alias("kind"), F.lit("Class").alias("type_name"), "repository", F.lit(None).cast("long").alias("declaring_type_id"), F.lit(None).cast("long").alias("container_id"), F.col("label").alias("full_name"), F.lit("").alias("file_path"))
    assert {r.repository: r.n_cycle for r in analysis.health(symbols, nodes, e).collect()} == {"r1": 1, "r2": 0}
