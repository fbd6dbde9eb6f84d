"""The engine's operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from symgraph.functions import ids, text
from symgraph.operators import analysis, graph, retrieval, search, tables
from symgraph.plans import export

SYMBOLS = "id string, repository string, name string, full_name string, kind string, type_name string, container_id string, declaring_type_id string, file_path string, start_line int, end_line int, return_type string, updated_at int"


def symbol(full, kind="Method", repo="r", type_name=None, container=None, owner=None, file="test.cs", at=1):
    return (full, repo, full.rsplit(".", 1)[-1], full, kind, type_name, container, owner, file, 1, 10, None, at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SYMBOLS)


def words(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k) for a, k, b in rows], "source_id string, target_id string, kind string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_lookups_upserts_and_removals(spark):
    s = frame(spark, symbol("A.Update"), symbol("B.Update"), symbol("C.Start"), symbol("T", "Type"), symbol("P", "Property"))
    assert tables.by_name(s, "Update").count() == 2
    assert [tables.by_kind(s, k).count() for k in ("Type", "Method", "Property")] == [1, 3, 1]
    newer = frame(spark, symbol("C.Start", at=2))
    merged = tables.latest(s.unionByName(newer), ["id"])
    assert merged.count() == 5 and tables.by_id(merged, "C.Start").first().updated_at == 2
    assert tables.upsert(s, newer, ["id"]).where("updated_at = 2").count() == 1
    assert tables.remove(s, s.where("id = 'T'"), "id").count() == 4
    assert tables.by_full_name(s, "A.Update").count() == 1 and tables.by_full_name(s, "none").count() == 0


@pytest.mark.parametrize(
    ("rows", "query", "want"),
    [
        ([("global::PlayerController", "Type")], "global::PlayerController", "global::PlayerController"),
        ([("global::PlayerController", "Type"), ("PlayerController", "Property")], "PlayerController", "PlayerController"),
        ([("global::GameService", "Type")], "gameservice", "global::GameService"),
        ([("global::SuperLongClassName", "Type")], "SuperLong", "global::SuperLongClassName"),
        ([("global::InventoryViewController", "Type")], "Inventory", "global::InventoryViewController"),
        ([("X.DoAction", "Method"), ("Y.DoAction", "Type")], "DoAction", "Y.DoAction"),
        ([("A.B", "Type")], "NonExistentThing", None),
        ([], "x", None),
    ],
)
def test_resolve(spark, rows, query, want):
    s = frame(spark, *[symbol(f, k) for f, k in rows])
    got = tables.resolve(s, words(spark, query)).first()
    assert (got and got.full_name) == want


def test_resolve_ranked_and_list(spark):
    s = frame(spark, symbol("global::Go", "Type"), symbol("Go", "Method"), symbol("x.GO", "Type", type_name="Interface"), symbol("N", "Namespace"))
    assert tables.resolve_ranked(s, words(spark, "Go")).first().full_name == "global::Go"
    assert tables.resolve_ranked(s, words(spark, "gO")).first().kind == "Type"
    rows = tables.list_symbols(s, name="go").collect()
    assert len(rows) == 3 and rows[0].total == 3
    assert [r.full_name for r in tables.list_symbols(s, "interface").collect()] == ["x.GO"]


def test_graph_edits(spark):
    n = spark.createDataFrame([(x, x, "Class", {"FilePath": f"{x}.cs"}) for x in "abc"], "id string, label string, kind string, metadata map<string,string>")
    e = edges(spark, ("a", "Calls", "b"), ("b", "Calls", "a"), ("b", "Calls", "c"), ("c", "Calls", "z"), ("c", "Calls", "z"))
    left, kept = tables.remove_nodes(n, e, n.where("id = 'b'"))
    assert left.count() == 2 and {r.source_id for r in kept.collect()} == {"c"}
    assert tables.distinct_edges(e).count() == 4 and tables.incoming(e, "b", "Calls").count() == 1 and tables.outgoing(e, "b").count() == 2
    assert tables.with_placeholders(n, e).where("kind = 'External'").first().id == "z"
    assert tables.nodes_by_file(n, "a.cs").count() == 1
    assert tables.hidden_projects(n, e, ["A.CS"])[1].count() == 3


def test_bfs_against_plain_search(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    e = spark.createDataFrame([(a, b, "Calls") for a, b in pairs], "source_id long, target_id long, kind string")
    for depth in (1, 2, 3, None):
        want = {}
        for s in (0, 7):
            seen, level, d = {}, {s}, 0
            while level and (depth is None or d < depth):
                d += 1
                new = {b for a, b in pairs if a in level} - seen.keys()
                seen |= {x: d for x in new}
                level = new - {s}
            want |= {(s, x): d for x, d in seen.items()}
        got = {(r.seed, r.node): r.depth for r in graph.bfs(e, spark.createDataFrame([(0,), (7,)], "seed long"), depth).collect()}
        assert got == want


def test_traversals(spark):
    e = edges(spark, ("Attack", "Calls", "Fire"), ("Fire", "Calls", "Spawn"), ("Enemy", "Implements", "IDamageable"), ("Dog", "Inherits", "Animal"), ("Puppy", "Inherits", "Dog"), ("Puppy.Bark", "Overrides", "Dog.Bark"), ("Loop", "Calls", "Loop"))
    at = lambda df: {r.node: r.depth for r in df.collect()}
    assert at(graph.callers(e, seeds(spark, "Spawn"), 1)) == {"Fire": 1}
    assert at(graph.callers(e, seeds(spark, "Spawn"), 2)) == {"Fire": 1, "Attack": 2}
    assert at(graph.callees(e, seeds(spark, "Attack"), 2)) == {"Fire": 1, "Spawn": 2}
    assert at(graph.callees(e, seeds(spark, "Loop"), 2)) == {"Loop": 1}
    assert at(graph.implementations(e, seeds(spark, "IDamageable"))) == {"Enemy": 1}
    assert at(graph.derived_types(e, seeds(spark, "Animal"))) == {"Dog": 1, "Puppy": 2}
    assert at(graph.ancestors(e, seeds(spark, "Puppy"))) == {"Dog": 1, "Animal": 2}
    assert at(graph.overrides(e, seeds(spark, "Dog.Bark"))) == {"Puppy.Bark": 1}
    assert at(graph.neighbourhood(e, seeds(spark, "Fire"))) == {"Attack": 1, "Spawn": 1}
    known = spark.createDataFrame([("Spawn",)], "id string")
    assert at(graph.callees(e, seeds(spark, "Attack"), 2, known)) == {}


def test_cycles_paths_and_patterns(spark):
    e = edges(spark, ("a", "Inherits", "b"), ("b", "DependsOn", "c"), ("c", "Inherits", "a"), ("x", "Inherits", "a"), ("p", "Inherits", "q"))
    assert {r.node for r in graph.cyclic_core(e).collect()} == {"a", "b", "c"}
    assert graph.cyclic_core(e.where("source_id != 'b'")).count() == 0
    pairs = spark.createDataFrame([("x", "c"), ("x", "q")], "seed string, target string")
    (r,) = graph.shortest_path(e, pairs).collect()
    assert r.path == ["x", "a", "b", "c"] and r.depth == 3
    assert [r.path for r in graph.all_paths(e, pairs).collect()] == [["x", "a", "b", "c"]]
    n = spark.createDataFrame([(i, "T" if i in "ab" else "U") for i in "abcxpq"], "id string, kind string")
    assert sorted(tuple(r) for r in graph.match_pattern(n, e, ["U", "T", "T"], ["Inherits", "Inherits"]).collect()) == [("c", "a", "b"), ("x", "a", "b")]
    total = graph.pagerank(edges(spark, ("a", "X", "b"), ("b", "X", "c"), ("c", "X", "a")), 6).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1)


def test_search_tiers(spark):
    s = frame(spark, symbol("red bolt", "Property"), symbol("X.red bolt", "Property"), symbol("red bolts", "Type"), symbol("dark bolt", "Field"), symbol("bold", "Local"))
    rows = {r.id: (r.score, r.match) for r in search.find_symbols(s, words(spark, "red bolt")).collect()}
    assert rows == {"red bolt": (1.0, "exact_full"), "X.red bolt": (0.9, "exact_name"), "red bolts": (0.7, "prefix"), "dark bolt": (0.4, "fuzzy")}
    assert search.find_symbols(s, words(spark, "red bolt"), fewest=3).count() == 3
    assert search.find_symbols(s, words(spark, "red bolt"), kind="Type").first().id == "red bolts"
    assert search.find_symbols(s, words(spark, "zz")).count() == 0
    two = frame(spark, symbol("Game.Player", repo="one"), symbol("Engine.Player", repo="two"))
    assert {r.repository for r in search.find_across(two, words(spark, "Player")).collect()} == {"one", "two"}


def test_source_text(spark):
    f = lambda t: spark.createDataFrame([("test.cs", t), ("gone.cs", None)], "file_path string, content string")
    found = lambda t, q, **k: search.source_text(f(t), words(spark, q), **k).collect()
    assert [r.line for r in found("class A {\n\n  void Initialize() {}\n}", "Initialize")] == [3]
    assert len(found("private string myField", "MYFIELD")) == 1 and found("x", "") == [] and found("x", "  ") == [] and found("class NoMatch {}", "Other") == []
    assert len(found("class A\nclass B : A\nclass C : A\nclass D", ": A")) == 2
    assert len(found("\n".join(f"// Line {i} public void" for i in range(50)), "public void", most=5)) == 5
    assert sorted(r.score for r in found("public class Score\n   // public class", "public class")) == [0.8, 1.0]
    s = frame(spark, symbol("M", "Method", file="test.cs"))
    assert len(found("DoWork", "DoWork", symbols=s)) == 1 and found("DoWork", "DoWork", symbols=s.where("kind = 'Type'")) == []


def test_health_comparison_and_risk(spark):
    big = frame(spark, symbol("Big", "Type", type_name="Class"), *[symbol(f"Big.m{i}", container="Big") for i in range(35)])
    n, e = big.select("id", "repository", F.col("name").alias("label"), F.lit("Class").alias("kind")), edges(spark).withColumn("repository", F.lit("r"))
    h = analysis.health(big, n, e).first()
    assert h.score == 95 and h.warnings == ["Large class: Big has 35 members"]
    small = frame(spark, *[symbol(f"C{i}", "Type", type_name="Class") for i in range(10)])
    h = analysis.health(small, small.select("id", "repository", F.col("name").alias("label"), F.lit("Class").alias("kind")), e).first()
    assert h.score == 100 and h.total == 10 and h.classes == 10
    s = frame(spark, symbol("Shared", repo="1"), symbol("Only1", repo="1"), symbol("Shared", repo="2"), symbol("Only2", repo="2"))
    assert tuple(analysis.compare_counts(s, "1", "2").first()) == (1, 1, 1)
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"a": 20, "b": 20, "c": 20, "d": 2, "e": 3}.items()])
    assert one.select(analysis.risk(*map(F.col, "abcde"))).first()[0] == 100
    assert [r[0] for r in spark.createDataFrame([(70,), (69,), (40,), (15,), (14,)], "s int").select(analysis.risk_level(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "MINIMAL"]
    refs = spark.createDataFrame([("b", "x", "Call", "Assert.Test(b)"), ("b", "y", "Call", None)], "symbol_id string, source_symbol_id string, kind string, context string")
    r = analysis.blast_radius(frame(spark, symbol("a"), symbol("b"), symbol("c")), edges(spark, ("a", "Calls", "b"), ("b", "Calls", "c"), ("z", "Calls", "a")), refs, seeds(spark, "b")).first()
    assert (r.callers, r.direct, r.indirect, r.callees, r.refs, r.tests, r.score, r.level) == (2, 1, 1, 1, 2, 1, 14, "MINIMAL")


def test_terms_tokens_and_ids(spark):
    one = spark.createDataFrame([("How does the PlayerController work? It is, well, ok!",)], "q string")
    assert one.select(text.terms(F.col("q"))).first()[0] == ["PlayerController", "work", "is", "well", "ok"]  # stop words go before marks do
    assert one.select(text.prompt_tokens(F.lit("abcdefg")), text.chunk_tokens(F.lit("abcdefg"))).first()[:] == (1, 3)
    assert one.select(text.trigrams(F.lit("AbcdA")), text.trigrams(F.lit("Ab"))).first()[:] == (["abc", "bcd", "cda"], ["ab"])
    import hashlib

    a, b = hashlib.md5(b"A").digest(), hashlib.md5(b"B").digest()
    want = hashlib.md5(a + b + (5).to_bytes(4, "little")).hexdigest()
    assert one.select(ids.edge_id(F.md5(F.lit("A")), F.md5(F.lit("B")), F.lit("Inherits"))).first()[0] == want


def test_vectors(spark):
    v = spark.createDataFrame([("c", "a", [1.0, 0.0, 0.0]), ("c", "b", [0.0, 1.0, 0.0]), ("c", "c", [0.9, 0.1, 0.0]), ("c", "zero", [0.0, 0.0, 0.0]), ("c", "short", [1.0])], "collection string, id string, vector array<float>")
    q = spark.createDataFrame([("q", "c", [1.0, 0.0, 0.0])], "query string, collection string, target array<float>")
    rows = retrieval.vector_search(v, q).orderBy("place").collect()
    assert [r.id for r in rows][:2] == ["a", "c"] and {r.score for r in rows[2:]} == {0.0}
    assert retrieval.scroll(v, "c", 2).count() == 2 and retrieval.collections(v).count() == 1 and retrieval.check_dimension(v, {"c": 3}).first().id == "short"
    assert retrieval.vector_search(v, q.withColumn("collection", F.lit("none"))).count() == 0


def test_context_and_rag(spark):
    s = frame(spark, symbol("Player", "Type"), symbol("Fire"), symbol("Attack"))
    e = edges(spark, ("Attack", "Calls", "Fire"), ("Player", "Calls", "Fire"))
    q = spark.createDataFrame([("what does Fire do",)], "question string")
    rows = {r.id: (r.source, r.score) for r in retrieval.evidence(s, e, q).collect()}
    assert rows == {"Fire": ("symbol_search", 1.0), "Attack": ("caller", 0.8), "Player": ("caller", 0.8)}
    chosen, links = retrieval.context(s, e, q)
    r = retrieval.context_summary(q, chosen, links).first()
    assert (r.symbols, r.relations, r.tokens) == (1, 2, 4 + 50 + 40) and r.confidence == pytest.approx(0.66) and r.sufficient
    prompt = retrieval.prompts(retrieval.evidence(s, e, q), s, graph.relationships(s, s, e)).first().prompt
    assert "### Fire" in prompt and "- Attack → Fire: Calls" in prompt
    budget = spark.createDataFrame([("g", i, 30) for i in range(5)], "g string, i int, tokens int")
    assert retrieval.within_budget(budget, 100, ["g"], ["i"]).count() == 3


def test_chunks_and_embeddings(spark):
    f = spark.createDataFrame([("a.cs", "\n".join(f"l{i}" for i in range(250)))], "file_path string, content string")
    assert [(r.start_line, r.end_line) for r in retrieval.chunk_lines(f).orderBy("start_line").collect()] == [(1, 100), (101, 200), (201, 250)]
    s = frame(spark, symbol("M", file="a.cs")).withColumn("start_line", F.lit(3)).withColumn("end_line", F.lit(4))
    assert retrieval.chunk_symbols(s, f).first().content == "l3\nl4"
    chunks = retrieval.chunk_by(f, lambda t: [t[:3], t[3:6], t[:3]])
    cache = spark.createDataFrame([], "content_hash string, model string, vector array<float>")
    rows = retrieval.embed(chunks, cache, "m").collect()
    assert len(rows) == 3 and rows[0].vector is not None and len({r.content_hash for r in rows}) == 2
    known = retrieval.embed(chunks, cache, "m").select("content_hash", "model", "vector").distinct()
    assert retrieval.cache_misses(chunks.withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("model", F.lit("m")), known).count() == 0


def test_exports(spark):
    n = spark.createDataFrame([("aaaaaaaaaa", "A", "A", "Class"), ("bbbbbbbbbb", "B", "B", "Method")], "id string, full_name string, label string, kind string")
    e = edges(spark, ("aaaaaaaaaa", "Calls", "bbbbbbbbbb"), ("aaaaaaaaaa", "Calls", "cccccccccc"))
    assert export.mermaid(n, e).first()[0] == 'graph TD\n    aaaaaaaa["A"]\n    bbbbbbbb["B"]\n    aaaaaaaa --> bbbbbbbb\n    aaaaaaaa --> cccccccc'
    assert {r.target_label for r in export.graph_edges(n, e).collect()} == {"B", "External(Calls)"}
    assert {(r.size, r.color) for r in export.graph_nodes(n).collect()} == {(10, "#58a6ff"), (5, "#3fb950")}
    assert export.prometheus(spark.createDataFrame([("a.b", 1.234)], "name string, value double")).first()[0] == "symgraph_a_b 1.23"


def test_written_tables_are_forgotten(spark):
    from symgraph import session

    kept = session.materialise(spark.range(5), "t")
    assert kept.count() == 5 and session.MADE
    path = session.MADE[-1].removeprefix("file://")
    session.forget(spark)
    import os

    assert not session.MADE and not os.path.exists(path)


def test_embedding_queue_asks_again(spark):
    import pandas as pd

    from symgraph.operators import retrieval

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return pd.Series([[float(len(t))] for t in texts])

    rows = [(f"h{i}", "m", "bad text" if i == 7 else f"text {i}") for i in range(40)] + [("h1", "m", "text 1")]
    assert retrieval.available(retrieval.hashing_embedder) and not retrieval.available(lambda t: 1 / 0)
    done, failed = retrieval.embed_queue(spark.createDataFrame(rows, "content_hash string, model string, content string").coalesce(1), embedder)
    assert [(r.content_hash, r.tries) for r in failed.collect()] == [("h7", 3)]
    assert [tuple(r) for r in retrieval.models(done).collect()] == [("m", 39, 1)]
    assert done.count() == 39 and done.where("tries > 1").count() > 0 and done.where("content_hash = 'h1'").first().vector == [6.0]


def test_many_vector_queries_are_dealt_in_blocks(spark, monkeypatch):
    from symgraph.operators import retrieval

    v = spark.range(60).selectExpr("'c' as collection", "id", "array(cast(id as float), cast(1 as float)) as vector")
    q = v.selectExpr("id as query", "collection", "vector as target")
    few = sorted((r.query, r.id, r.place) for r in retrieval.vector_search(v, q, 3).collect())
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 7)
    assert sorted((r.query, r.id, r.place) for r in retrieval.vector_search(v, q, 3).collect()) == few and len(few) == 180


def test_vector_blocks_against_pairs_one_by_one(spark, monkeypatch):
    from pyspark.sql import Window

    from symgraph.functions.text import cosine, dot, euclidean
    from symgraph.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(retrieval, "VECTORS_AT_ONCE", 16)
    monkeypatch.setattr(retrieval, "TILE", 4)
    rows = [("c", i, [float(i * 7 % 11) - 5, float(i * 5 % 13) / 3, 1.5]) for i in range(80)] + [("d", 100 + i, [1.0, 2.0, 3.0]) for i in range(40)]  # many ties
    rows += [("c", 200, None), ("c", 201, [1.0, None, 2.0]), ("c", 202, [float("nan"), 1.0, 1.0]), ("c", 203, [1.0, 2.0]), ("c", 204, []), ("c", 205, [0.0, 0.0, 0.0]), ("d", 206, [1e300, 1e-300, 1.0]), ("e", 207, [1.0])]
    v = spark.createDataFrame(rows, "collection string, id long, vector array<double>")
    q = v.where("id % 3 = 0 or id >= 200").selectExpr("concat('q', id) as query", "collection", "vector as target")
    for measure, f in (("cosine", cosine), ("dot", dot), ("euclidean", lambda a, b: -euclidean(a, b))):
        for least in (None, 0.5):
            pairs = v.join(q, "collection").select("query", "id", f(F.col("vector"), F.col("target")).alias("score"))
            pairs = pairs if least is None else pairs.where(F.col("score") >= least)
            want = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("place <= 4")
            said = lambda df: sorted(map(repr, df.select("query", "id", "score", "place").collect()))
            found = retrieval.vector_search(v, q, 4, measure=measure, least=least)
            assert "CoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # not pair by pair
            assert said(found) == said(want)


def test_grams_of_queries_go_to_the_symbols(spark):
    s = spark.range(500).selectExpr("cast(id as string) as id", "'Method' as kind", "concat('aaa', id) as name", "concat('x.aaa', id) as full_name")
    found = search.by_trigrams(s, spark.createDataFrame([("aaa7",)], "query string"), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan  # the gram that all have isn't one task's
    assert "aggregate(first" not in plan.lower() and "first(" not in plan  # strings as buffers are sorted
    assert [(r.id, r.overlap) for r in found.orderBy(F.desc("overlap"), "id").collect()] == [("7", 2), ("70", 2), ("71", 2)]


def test_small_levels_go_to_the_edges(spark):
    """Edges are not shuffled for a few seeds, and repeated ones count once."""
    edges = spark.createDataFrame([("a", "b", "Calls"), ("a", "b", "Calls"), ("c", "b", "Calls"), ("x", "a", "Calls")], "source_id string, target_id string, kind string")
    found = graph.callers(edges, spark.createDataFrame([("b",)], "seed string"), 1)
    assert "Join Inner" in (text := found._jdf.queryExecution().optimizedPlan().toString()) and "broadcast" in text and text.count("Aggregate") == 1
    assert sorted(r.node for r in found.collect()) == ["a", "c"]


def test_index_of_texts_is_made_without_a_shuffle(spark):
    """And a repeated file is found all the same."""
    files = spark.createDataFrame([("f", "The cat"), ("f", "The cat"), ("g", "a dog")], "file_path string, content string")
    index = search.text_index(files)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert {r.file_path for r in search.source_text(files, words(spark, "the cat"), index=index).collect()} == {"f"}


def test_runs_of_a_question_do_not_carry_its_text(spark):
    """(F15)"""
    asked = spark.createDataFrame([(1, "Where is the red bolt?"), (1, "Where is the red bolt?"), (2, "bolt")], "conv int, question string")
    found = retrieval.entities(asked, spark.createDataFrame([("red bolt", 7), ("bolt", 8)], "name string, id int"))
    generated = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    assert generated and all("question" not in line for line in generated)
    assert sorted((r.conv, r.place, r.words, r.id) for r in found.collect()) == [(1, 4, 2, 7), (2, 1, 1, 8)]


def test_impact_is_summed_before_one_join(spark):
    """Five joins of counts held their sorts in one task."""
    s = spark.createDataFrame([("a", "a", "a", "Method", None), ("b", "b", "b", "Method", None)], "id string, name string, full_name string, kind string, type_name string")
    e = spark.createDataFrame([("a", "b", "Calls"), ("a", "b", "Calls")], "source_id string, target_id string, kind string")
    refs = spark.createDataFrame([("b", "A Test"), ("b", None), ("c", None)], "symbol_id string, context string")
    found = analysis.blast_radius(s, e, refs, s.select(F.col("id").alias("seed")), 1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert sorted((r.seed, r.callers, r.direct, r.indirect, r.callees, r.refs, r.tests, r.derived) for r in found.collect()) == [("a", 0, 0, 0, 1, 0, 0, 0), ("b", 1, 1, 0, 0, 2, 1, 0)]
