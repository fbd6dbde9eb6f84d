"""Queries that traverse the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.operators import analysis, graph
from symgraph.plans import adapters as A
from symgraph.plans.adapters import CALLS, DECLARES, INHERITS, NODES, REFS, SYMBOLS, with_ctes
from symgraph.registry import query
from symgraph.session import table


def _walk(start: str, src: str, dst: str, edges: str, depth: int) -> str:
    """Nodes and least depths from a few seeds, for DuckDB."""
    return f"walk(seed, node, depth) AS (SELECT seed, {dst}, 1 FROM {start} JOIN {edges} ON {src} = seed UNION SELECT w.seed, e.{dst}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{src} = w.node WHERE w.depth < {depth})"


SEEDS = "seeds(seed) AS (VALUES (0::bigint), (17::bigint))"


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids or (0, 17)], "seed long")


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node", SEEDS, CALLS, _walk("seeds", "target_id", "source_id", "calls", 2)))
def callers_depth2(spark, d):
    return graph.callers(A.calls(spark, d), seeds(spark), 2).select("seed", "node", "depth")


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node", SEEDS, CALLS, _walk("seeds", "source_id", "target_id", "calls", 2)))
def callees_depth2(spark, d):
    return graph.callees(A.calls(spark, d), seeds(spark), 2).select("seed", "node", "depth")


BOTH = "ways AS (SELECT source_id AS src, target_id AS dst FROM calls UNION SELECT target_id, source_id FROM calls)"


@query(
    with_ctes(
        "SELECT seed, node, depth, round(1.0::double / (1 + depth), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM (SELECT seed, node, min(depth) AS depth FROM walk WHERE node != seed GROUP BY seed, node)) WHERE n <= 50",
        SEEDS, CALLS, BOTH, _walk("seeds", "src", "dst", "ways", 2),
    )
)
def neighbourhood_depth2(spark, d):
    return graph.neighbourhood(A.calls(spark, d), seeds(spark)).select("seed", "node", "depth", F.round("score", 9).alias("score"))


@query("SELECT p_type AS seed, p_partkey::varchar AS node FROM part WHERE p_type IN ('PROMO', 'LARGE')")
def implementations(spark, d):
    return graph.implementations(A.implements(spark, d), spark.createDataFrame([("PROMO",), ("LARGE",)], "seed string")).select("seed", "node")


@query("SELECT c_custkey // 5 AS seed, c_custkey AS node FROM customer WHERE c_custkey > 0 AND c_custkey // 5 IN (3, 4)")
def overrides(spark, d):
    return graph.overrides(A.inherits(spark, d).withColumn("kind", F.lit("Overrides")), seeds(spark, 3, 4)).select("seed", "node")


DOWN = _walk("seeds", "target_id", "source_id", "inherits", 60)


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node", "seeds(seed) AS (VALUES (1::bigint), (2::bigint))", INHERITS, DOWN))
def derived_types(spark, d):
    return graph.derived_types(A.inherits(spark, d), seeds(spark, 1, 2)).select("seed", "node", "depth")


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node", "seeds(seed) AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)", INHERITS, _walk("seeds", "source_id", "target_id", "inherits", 60)))
def type_ancestors(spark, d):
    s = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("seed"))
    return graph.ancestors(A.inherits(spark, d), s).select("seed", "node", "depth")


@query(with_ctes("SELECT e.source_id, s.full_name AS from_name, n.full_name AS to_name, e.kind FROM declares e JOIN symbols s ON s.id = e.source_id JOIN nodes n ON n.id = e.target_id", SYMBOLS, NODES, DECLARES))
def relationships(spark, d):
    s = A.symbols(spark, d)
    return graph.relationships(s, A.nodes(spark, d), A.declares(spark, d)).select("source_id", "from_name", "to_name", "kind")


RISK = "least(100, least(5 * callers, 50) + least(2 * callees, 20) + least(refs, 15) + least(10 * derived, 15) + least(5 * implementations, 10))"
IMPACT = """sym AS (SELECT 'p' || p_partkey AS id, 'Method' AS kind, '' AS of FROM part UNION ALL SELECT 'c' || c_custkey, 'Type', 'Class' FROM customer UNION ALL SELECT DISTINCT p_type, 'Type', 'Interface' FROM part),
links AS (SELECT 'p' || source_id AS s, 'p' || target_id AS t, 'Calls' AS kind FROM calls UNION ALL SELECT 'c' || source_id, 'c' || target_id, 'Inherits' FROM inherits UNION ALL SELECT 'p' || p_partkey, p_type, 'Implements' FROM part),
used AS (SELECT 'p' || symbol_id AS id, count(*) AS refs, count(*) FILTER (contains(context, 'Test')) AS tests FROM refs GROUP BY 1)"""
LEVEL = "CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 15 THEN 'LOW' ELSE 'MINIMAL' END AS level"


def _impact(spark, d):
    """Parts as methods, customers as classes, types of parts as interfaces; their edges and references."""
    c = lambda prefix, name: F.concat(F.lit(prefix), F.col(name).cast("string"))
    row = lambda df, x, kind, of: df.select(x.alias("id"), x.alias("name"), x.alias("full_name"), F.lit(kind).alias("kind"), F.lit(of).cast("string").alias("type_name"))
    part = table(spark, d, "part")
    s = row(part, c("p", "p_partkey"), "Method", None).unionByName(row(table(spark, d, "customer"), c("c", "c_custkey"), "Type", "Class")).unionByName(row(part.select("p_type").distinct(), F.col("p_type"), "Type", "Interface"))
    ends = lambda df, a, b: df.select(c(a, "source_id").alias("source_id"), c(b, "target_id").alias("target_id"), "kind")
    e = ends(A.calls(spark, d), "p", "p").unionByName(ends(A.inherits(spark, d), "c", "c")).unionByName(ends(A.implements(spark, d), "p", ""))
    return s, e, A.refs(spark, d).withColumn("symbol_id", c("p", "symbol_id"))


@query(
    with_ctes(
        f"""SELECT seed, kind, callers, callees, refs, tests, derived, implementations, score, {LEVEL} FROM (SELECT *, ({RISK})::int AS score FROM (
SELECT sym.id AS seed, kind, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, coalesce(refs, 0) AS refs, coalesce(tests, 0) AS tests, coalesce(w.n, 0) AS derived, coalesce(m.n, 0) AS implementations FROM sym
LEFT JOIN (SELECT t, count(*) AS n FROM links WHERE kind = 'Calls' GROUP BY 1) i ON i.t = id LEFT JOIN (SELECT s, count(*) AS n FROM links WHERE kind = 'Calls' GROUP BY 1) o ON o.s = id LEFT JOIN used USING (id)
LEFT JOIN (SELECT seed, count(DISTINCT node) AS n FROM walk GROUP BY 1) w ON w.seed = id LEFT JOIN (SELECT t, count(*) AS n FROM links WHERE kind = 'Implements' GROUP BY 1) m ON m.t = id))""",
        CALLS, INHERITS, REFS, IMPACT, "seeds(seed) AS (SELECT id FROM sym WHERE of = 'Class')", "down AS (SELECT * FROM links WHERE kind = 'Inherits')", _walk("seeds", "t", "s", "down", 60),
    )
)
def blast_radius(spark, d):
    """G6 at depth 1 for every symbol: the flagship query."""
    s, e, r = _impact(spark, d)
    rows = analysis.blast_radius(s, e, r, s.select(F.col("id").alias("seed")), 1)
    return rows.drop("full_name", "direct", "indirect", "summary").withColumn("score", F.col("score").cast("int"))


@query(
    with_ctes(
        f"""SELECT seed, callers, direct, indirect, callees, refs, tests, derived, implementations, score, {LEVEL},
'Changing ' || seed || ' (' || kind || ') would directly affect ' || callers || ' caller(s).' || CASE WHEN callees > 0 THEN ' It calls ' || callees || ' other method(s).' ELSE '' END || CASE WHEN refs > 1 THEN ' There are ' || refs || ' total references.' ELSE '' END
 || CASE WHEN derived > 0 THEN ' ' || derived || ' type(s) inherit from this type.' ELSE '' END || CASE WHEN implementations > 0 THEN ' ' || implementations || ' type(s) implement this interface.' ELSE '' END
 || CASE WHEN tests = 0 THEN ' ⚠️ WARNING: No test coverage found.' ELSE ' ✓ ' || tests || ' test(s) reference this symbol.' END AS summary
FROM (SELECT *, ({RISK})::int AS score FROM (SELECT seed, kind, (SELECT count(*) FROM up WHERE up.seed = x.seed) AS callers, (SELECT count(*) FROM up WHERE up.seed = x.seed AND depth = 1) AS direct, (SELECT count(*) FROM up WHERE up.seed = x.seed AND depth > 1) AS indirect,
(SELECT count(*) FROM down WHERE down.seed = x.seed) AS callees, coalesce((SELECT refs FROM used WHERE used.id = x.seed), 0) AS refs, coalesce((SELECT tests FROM used WHERE used.id = x.seed), 0) AS tests,
(SELECT count(DISTINCT node) FROM below WHERE below.seed = x.seed) AS derived, CASE WHEN of = 'Interface' THEN (SELECT count(*) FROM links WHERE kind = 'Implements' AND t = x.seed) ELSE 0 END AS implementations FROM seeds x JOIN sym ON sym.id = x.seed))""",
        "seeds(seed) AS (VALUES ('p0'), ('p17'), ('c1'), ('c2'), ('PROMO'))", CALLS, INHERITS, REFS, IMPACT, "c AS (SELECT * FROM links WHERE kind = 'Calls')", "i AS (SELECT * FROM links WHERE kind = 'Inherits')", _walk("seeds", "t", "s", "c", 2), "up AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2)",
        _walk("seeds", "s", "t", "c", 2).replace("walk", "walk2"), "down AS (SELECT seed, node, min(depth) AS depth FROM walk2 GROUP BY 1, 2)", _walk("seeds", "t", "s", "i", 60).replace("walk", "below"),
    )
)
def blast_radius_depth2(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("p0", "p17", "c1", "c2", "PROMO")], "seed string")
    s, e, r = _impact(spark, d)
    return analysis.blast_radius(s, e, r, asked).drop("full_name", "kind").withColumn("score", F.col("score").cast("int"))


@query(
    with_ctes(
        "SELECT p_brand AS repository, node, min(depth) AS depth, round(1 - 0.2::double * min(depth), 9) AS score, 'calls' AS relation FROM walk JOIN part ON p_partkey = node WHERE seed = 0 GROUP BY p_brand, node",
        SEEDS, CALLS, _walk("seeds", "target_id", "source_id", "calls", 2),
    )
)
def cross_repo_callers(spark, d):
    found = graph.callers(A.calls(spark, d), seeds(spark, 0), 2)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("repository"))
    return found.join(part, "node").select("repository", "node", "depth", F.round(1 - 0.2 * F.col("depth"), 9).alias("score"), F.lit("calls").alias("relation"))


@query(with_ctes("SELECT p_brand AS repository, p_partkey AS node, 1.0::double AS score, 'implements' AS relation FROM part WHERE p_type = 'PROMO'"))
def cross_repo_implementations(spark, d):
    found = graph.implementations(A.implements(spark, d), spark.createDataFrame([("PROMO",)], "seed string")).select(F.col("node").cast("long").alias("node"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("repository"))
    return found.join(part, "node").select("repository", "node", F.lit(1.0).alias("score"), F.lit("implements").alias("relation"))


@query(with_ctes("SELECT DISTINCT node FROM walk WHERE node = seed", "seeds(seed) AS (SELECT c_custkey FROM customer)", "loops AS (SELECT c_custkey AS source_id, c_custkey // 5 AS target_id FROM customer WHERE c_custkey > 0 UNION ALL SELECT 1, 30 UNION ALL SELECT 2, 13 UNION ALL SELECT 17, 17 UNION ALL SELECT 2, 40)", _walk("seeds", "source_id", "target_id", "loops", 12)))
def cycle_detection(spark, d):
    """The planted edges close 1, 30, 6 and 2, 13 to cycles, and 17 upon itself; 40 and 8 lie between two cycles."""
    e = A.inherits(spark, d).unionByName(spark.createDataFrame([(1, 30, "Inherits"), (2, 13, "Inherits"), (17, 17, "Inherits"), (2, 40, "Inherits")], "source_id long, target_id long, kind string"))
    return graph.cyclic_core(e)


@query(
    with_ctes(
        "SELECT seed, node AS target, depth::int AS depth FROM (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2) WHERE node IN (50, 60, 70) AND node != seed",
        SEEDS, CALLS, _walk("seeds", "source_id", "target_id", "calls", 2),
    )
)
def shortest_path(spark, d):
    pairs = seeds(spark).crossJoin(spark.createDataFrame([(50,), (60,), (70,)], "target long"))
    found = graph.shortest_path(A.calls(spark, d), pairs, 2)
    return found.select("seed", "target", F.col("depth").cast("int").alias("depth"))


@query(with_ctes("SELECT a.source_id AS n0, a.target_id AS n1, b.target_id AS n2 FROM inherits a JOIN inherits b ON b.source_id = a.target_id JOIN customer x ON x.c_custkey = a.source_id JOIN customer z ON z.c_custkey = b.target_id WHERE x.c_mktsegment = 'MACHINERY' AND z.c_mktsegment = 'MACHINERY'", INHERITS))
def pattern_match(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return graph.match_pattern(n, A.inherits(spark, d), ["MACHINERY", None, "MACHINERY"], ["Inherits", "Inherits"])


def _rank_sql(rounds: int) -> list[str]:
    out = ["e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM inherits)", "g AS (SELECT src, count(*) AS n FROM e GROUP BY 1)", "v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "r0 AS (SELECT node, 1.0::double / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS (SELECT v.node, 0.15::double / (SELECT count(*) FROM v) + 0.85 * coalesce(s, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / n) AS s FROM e JOIN g USING (src) JOIN r{i - 1} ON node = src GROUP BY dst) ON dst = node)")
    return out


@query(with_ctes("SELECT node, round(rank, 8) AS rank FROM r5", INHERITS, *_rank_sql(5)))
def pagerank(spark, d):
    return graph.pagerank(A.inherits(spark, d), 5).select("node", F.round("rank", 8).alias("rank"))


@query(with_ctes("SELECT target_id AS node, count(*) AS incoming, round(ln(1 + count(*)), 8) AS score FROM calls GROUP BY 1", CALLS))
def reference_score(spark, d):
    return graph.reference_scores(A.calls(spark, d)).withColumn("score", F.round("score", 8))


@query(with_ctes("SELECT node, round(sum(1.0::double / (1 + depth)), 8) AS score FROM (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2) GROUP BY node", SEEDS, CALLS, _walk("seeds", "source_id", "target_id", "calls", 2)))
def distance_score(spark, d):
    return graph.distance_scores(graph.callees(A.calls(spark, d), seeds(spark), 2)).withColumn("score", F.round("score", 8))


@query(
    with_ctes(
        "SELECT node, round(max(score), 8) AS score FROM (SELECT 1::bigint AS node, 1.0::double AS score UNION ALL FROM l1 UNION ALL FROM l2) GROUP BY node",
        INHERITS, "step AS (SELECT src, dst, max(w) AS w FROM (SELECT source_id AS src, target_id AS dst, 0.9::double AS w FROM inherits UNION ALL SELECT target_id, source_id, 0.9::double * 0.8 FROM inherits) GROUP BY 1, 2)",
        "l1 AS (SELECT dst AS node, max(1.0::double * w * 0.5) AS score FROM step WHERE src = 1 GROUP BY 1)", "l2 AS (SELECT dst AS node, max(score * w * 0.5) AS score FROM l1 JOIN step ON src = node GROUP BY 1)",
    )
)
def relevance_expansion(spark, d):
    s = spark.createDataFrame([(1, 1.0)], "seed long, score double")
    return graph.expand_relevance(A.inherits(spark, d), s, {"Inherits": 0.9}).withColumn("score", F.round("score", 8))


@query(with_ctes("SELECT source_id, target_id FROM inherits WHERE source_id IN (SELECT node FROM inside) AND target_id IN (SELECT node FROM inside)", "seeds(seed) AS (VALUES (1::bigint))", INHERITS, "ways AS (SELECT source_id AS src, target_id AS dst FROM inherits UNION SELECT target_id, source_id FROM inherits)", _walk("seeds", "src", "dst", "ways", 2), "inside AS (SELECT node FROM walk UNION SELECT 1::bigint)"))
def subgraph(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.subgraph(n, A.inherits(spark, d), seeds(spark, 1), 2)[1].select("source_id", "target_id")


@query(with_ctes("SELECT a.source_id || '>' || a.target_id || '>' || b.target_id AS path FROM inherits a JOIN inherits b ON b.source_id = a.target_id WHERE a.source_id IN (300, 777) AND a.source_id != b.target_id", INHERITS))
def all_paths(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("target")).crossJoin(seeds(spark, 300, 777))  # two seeds
    found = graph.all_paths(A.inherits(spark, d), pairs, 2).where(F.size("path") == 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


CHAINS = "loops AS (SELECT c_custkey AS source_id, c_custkey // 5 AS target_id FROM customer WHERE c_custkey > 0 UNION ALL SELECT 1, 30 UNION ALL SELECT 2, 13 UNION ALL SELECT 17, 17 UNION ALL SELECT 2, 40), seeds(seed) AS (SELECT c_custkey FROM customer)"


@query(with_ctes("SELECT a.seed AS node, min(a.node) AS component FROM walk a JOIN walk b ON a.seed = b.node AND a.node = b.seed GROUP BY a.seed", CHAINS, _walk("seeds", "source_id", "target_id", "loops", 12)))
def cycle_components(spark, d):
    """Which cycle each node of cycle_detection is on."""
    e = A.inherits(spark, d).unionByName(spark.createDataFrame([(1, 30, "Inherits"), (2, 13, "Inherits"), (17, 17, "Inherits"), (2, 40, "Inherits")], "source_id long, target_id long, kind string"))
    return graph.strong_components(e, ("Inherits",))


@query(
    with_ctes(
        "SELECT node, any_value(parent) AS parent, max(depth) AS depth, any_value(pre) AS pre, any_value(post) AS post, any_value(size) AS size FROM numbers GROUP BY node",
        "up AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN c_custkey // 5 END AS parent FROM customer)",
        "paths(node, parent, path) AS (SELECT node, parent, [node] FROM up WHERE parent IS NULL UNION ALL SELECT up.node, up.parent, list_append(path, up.node) FROM up JOIN paths ON up.parent = paths.node)",
        "below AS (SELECT unnest(path) AS node, count(*) AS size FROM paths GROUP BY 1)",
        "numbers AS (SELECT node, parent, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY list_append(path, 9223372036854775807)) - 1 AS post, size FROM paths JOIN below USING (node))",
    )
)
def depth_first_order(spark, d):
    """Depth-first numbers of the customers' forest."""
    up = A.inherits(spark, d).select(F.col("source_id").alias("node"), F.col("target_id").alias("parent"))
    return graph.forest_order(up, table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query(with_ctes("SELECT DISTINCT a.x AS a, a.y AS b, b.y AS c FROM ways a JOIN ways b ON a.y = b.x JOIN ways c ON c.x = a.x AND c.y = b.y", CALLS, "ways AS (SELECT DISTINCT least(source_id, target_id) AS x, greatest(source_id, target_id) AS y FROM calls WHERE source_id != target_id)"))
def pattern_triangles(spark, d):
    """All triangles of the parts' calls."""
    return graph.triangles(A.calls(spark, d))


PATTERN_NODES = "kinds AS (SELECT p_partkey AS id, p_brand AS kind FROM part)"


@query(
    with_ctes(
        "SELECT x.source_id AS hub, x.target_id AS one, y.target_id AS two, z.source_id AS back FROM calls x JOIN calls y ON x.source_id = y.source_id AND x.target_id != y.target_id JOIN calls z ON z.target_id = x.source_id AND z.source_id NOT IN (x.target_id, y.target_id) "
        "JOIN kinds h ON h.id = x.source_id AND h.kind = 'Brand#11' JOIN kinds a ON a.id = x.target_id AND a.kind = 'Brand#7' JOIN kinds b ON b.id = y.target_id AND b.kind = 'Brand#23' JOIN kinds c ON c.id = z.source_id AND c.kind = 'Brand#17' WHERE x.source_id NOT IN (x.target_id, y.target_id, z.source_id)",
        CALLS, PATTERN_NODES,
    )
)
def pattern_star(spark, d):
    """Parts of one brand with calls to two others and from a third."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"))
    return graph.match_graph(n, A.calls(spark, d), {"hub": "Brand#11", "one": "Brand#7", "two": "Brand#23", "back": "Brand#17"}, [("hub", "Calls", "one"), ("hub", "Calls", "two"), ("back", "Calls", "hub")])


@query(
    with_ctes(
        "SELECT x.source_id AS a, x.target_id AS b, y.target_id AS c FROM calls x JOIN calls y ON y.source_id = x.target_id JOIN calls z ON z.source_id = y.target_id AND z.target_id = x.source_id JOIN kinds k ON k.id = x.source_id AND k.kind = 'Brand#11' WHERE x.source_id != x.target_id AND y.target_id NOT IN (x.source_id, x.target_id)",
        CALLS, PATTERN_NODES,
    )
)
def pattern_cycle(spark, d):
    """Directed cycles of three calls through a brand."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"))
    return graph.match_graph(n, A.calls(spark, d), {"a": "Brand#11", "b": None, "c": None}, [("a", "Calls", "b"), ("b", "Calls", "c"), ("c", "Calls", "a")])
