"""Traversal of the graph: level by level, for any number of seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.session import broadcast_if, fits, materialise, rows


def _ways(edges: DataFrame, direction: str, kinds: tuple[str, ...]) -> DataFrame:
    some = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = some.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def oriented(edges: DataFrame, direction: str = "out", kinds: tuple[str, ...] = ()) -> DataFrame:
    """src, dst in the direction of travel: out, in or both."""
    return _ways(edges, direction, kinds).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, direction: str = "out", kinds: tuple[str, ...] = (), nodes: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """seed, node, depth, parent: what each seed reaches, by the least number of steps.

    A seed is not marked as reached, so it is in its own result if a cycle leads back to it; it is expanded once. With
    nodes (id), others are neither reported nor expanded. A cap stops a seed's search once it has so many nodes. Each level
    but the last is written, so plans grow by a join a level, and an empty one ends the search, so cycles do; beyond 3
    levels the edges are written once, too. A small level goes to the edges, which are then not shuffled.
    """
    long = max_depth is None or max_depth > 3
    step = _ways(edges, direction, kinds)
    within = lambda df, c: df if nodes is None else df.join(nodes.select(F.col("id").alias(c)), c, "left_semi").select(df.columns)
    if long:
        step = materialise(within(step.distinct(), "dst"), "bfs-edges")
    frontier = materialise(seeds.select(F.col("seed"), F.col("seed").alias("at")).distinct(), "bfs-seeds", True)
    frontier = broadcast_if(frontier, 100_000)
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, F.col("at") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(F.min("at").alias("parent"))
        if not long:
            reached = within(reached, "node")
        fresh = reached if found is None else reached.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        fresh = fresh.select("seed", "node", F.lit(depth).alias("depth"), "parent")
        if depth != max_depth:
            fresh = materialise(fresh, "bfs-level", True)
            if not rows(fresh):
                break
        found = fresh if found is None else found.unionByName(fresh)
        frontier = fresh.where("node != seed").select("seed", F.col("node").alias("at"))
        small = depth != max_depth and fits(fresh, 100_000)
        if cap is not None:
            open_ = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < cap)
            frontier = frontier.join(open_, "seed", "left_semi")
        frontier = F.broadcast(frontier) if small else frontier
    if found is None:
        found = frontier.select("seed", F.col("at").alias("node"), F.lit(0).alias("depth"), F.col("at").alias("parent")).limit(0)
    if cap is not None:
        place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
        found = found.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")
    return found


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """G1."""
    return bfs(edges, seeds, depth, "in", ("Calls",), nodes)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """G2."""
    return bfs(edges, seeds, depth, "out", ("Calls",), nodes)


def implementations(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, transitive: bool = False) -> DataFrame:
    """G3; transitive ones go through derived interfaces and types as well."""
    return bfs(edges, seeds, None, "in", ("Implements", "Inherits"), nodes) if transitive else bfs(edges, seeds, 1, "in", ("Implements",), nodes)


def derived_types(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All types below, with their depth."""
    return bfs(edges, seeds, None, "in", ("Inherits",), nodes)


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The bases of a type, nearest first."""
    return bfs(edges, seeds, None, "out", ("Inherits",))


def overrides(edges: DataFrame, seeds: DataFrame, recursive: bool = False) -> DataFrame:
    """G5, D9."""
    return bfs(edges, seeds, None if recursive else 1, "in", ("Overrides",))


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """What the seeds depend on."""
    return bfs(edges, seeds, depth, "out", ("DependsOn", "Uses", "AssemblyDep"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int = 50) -> DataFrame:
    """Undirected, any kind, without the seed; score 1/(1+depth)."""
    found = bfs(edges, seeds, depth, "both", cap=cap + 1).where("node != seed")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    found = found.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")
    return found.withColumn("score", 1 / (1 + F.col("depth")))


def relationships(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """from_name, to_name, kind of edges that leave symbols and whose target exists (G9, J1); with sources (id), of these."""
    if sources is not None:
        some = materialise(sources.select(F.col("id").alias("source_id")).distinct(), "sources", True)
        edges = edges.join(broadcast_if(some, 100_000), "source_id", "left_semi")
    s, n = symbols.select(F.col("id").alias("source_id"), F.col("full_name").alias("from_name")), nodes.select(F.col("id").alias("target_id"), F.col("full_name").alias("to_name"))
    return edges.join(s, "source_id").join(n, "target_id").select("source_id", "target_id", "from_name", "to_name", "kind")


def peeled(left: DataFrame) -> DataFrame:
    """left (src, dst) without the nodes that nothing leads to, or that lead to nothing, again and again. Each round is written."""
    left = materialise(left, "core", True)
    while rows(left):
        ends = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = materialise(ends.join(ends.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "core", True)
        if rows(now) == rows(left):
            return now
        left = now
    return left


def strong_components(edges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """node, component (its smallest node) of the nodes on a cycle: those that reach one another, and self-loops.

    After peeling, every node takes the smallest node that reaches it as its colour; the nodes that reach their colour's own
    node within the colour are its component. Components and edges between colours then go, the rest is peeled again, and
    so on until nothing is left; a component never has two colours. A step along the edges is a job.
    """
    left, out = peeled(oriented(edges, "out", kinds)), None
    if rows(left):
        loops = materialise(left.where("src = dst").select(F.col("src").alias("node")), "loops")
    while rows(left):
        colour = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node"))
        moved = True
        while moved:
            given = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("given"))
            colour = materialise(colour.join(given, "node", "left").select("node", F.least("colour", "given").alias("colour"), (F.col("given") < F.col("colour")).alias("moved")), "colours")
            moved = not colour.where("moved").isEmpty()
            colour = colour.drop("moved")
        of = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        inside = left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
        inside = materialise(inside.select("src", "dst", F.col("src_colour").alias("colour")), "coloured")
        found = level = materialise(colour.where("node = colour"), "components", True)
        while rows(level):
            behind = inside.join(level.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            level = materialise(behind.join(found.select("node"), "node", "left_anti"), "components", True)
            found = found.unionByName(level)
        found = materialise(found, "components")
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = peeled(rest.select("src", "dst"))
    if out is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component"))
    several = out.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
    kept = out.join(several, "colour", "left_semi").unionByName(out.join(several, "colour", "left_anti").join(loops, "node", "left_semi"))
    return kept.select("node", F.col("colour").alias("component"))


def cyclic_core(edges: DataFrame, kinds: tuple[str, ...] = ("Inherits", "Implements", "DependsOn")) -> DataFrame:
    """The nodes that reach themselves."""
    return strong_components(edges, kinds).select("node")


def forest_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, parent, depth, size of forest_order(), without its numbers."""
    up = edges.select("node", "parent").where("parent is not null").distinct()
    every = up.select("node").unionByName(up.select(F.col("parent").alias("node"))).distinct()
    if nodes is not None:
        every = every.unionByName(nodes.select("node")).distinct()
    known = materialise(every.join(up, "node", "left").select("node", "parent", F.col("parent").alias("above"), F.lit(1).cast("long").alias("size"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "forest", True)
    if rows(known) != every.count():
        raise ValueError("a node has two parents")
    at = known
    for k in range(64):
        if at.where("above is not null").isEmpty():
            break
        if 1 << k > rows(known):
            raise ValueError("the edges have a cycle")
        given = at.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.sum("size").alias("more"))
        ahead = at.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("further"))
        at = at.join(ahead, "above", "left").join(given, "node", "left")
        at = materialise(at.select("node", "parent", F.col("next").alias("above"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")), "forest-sizes")
    return at.select("node", "parent", "depth", "size")


def forest_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Node, parent, depth, pre, post, size (nodes below it, itself included) of a forest (node, parent), in depth-first
    order: trees and children by their ids, pre and post from 0 over the whole forest.

    A node's descendants are those whose pre lies in [pre, pre + size), so counts below a node need no pairs. Nodes double
    the steps that they look upwards, so rounds are the logarithm of the depth: sizes are added to the node 2^k steps up,
    and then a node's number is the sum, over itself and what is above it, of what comes before it under its parent.
    A node with two parents, or a cycle, is an error; a parent that is not a node is one, as a root.
    """
    at = forest_sizes(edges, nodes)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pre = at.select("node", "parent", "size", "depth", F.col("parent").alias("above"), (before + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("pre"))
    pre = materialise(pre, "forest-numbers")
    while not pre.where("above is not null").isEmpty():
        ahead = pre.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("pre").alias("further"))
        pre = materialise(pre.join(ahead, "above", "left").select("node", "parent", "size", "depth", F.col("next").alias("above"), (F.col("pre") + F.coalesce("further", F.lit(0))).alias("pre")), "forest-numbers")
    return pre.select("node", "parent", "depth", "pre", (F.col("pre") + F.col("size") - 1 - F.col("depth")).alias("post"), "size")


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int = 4, direction: str = "out", kinds: tuple[str, ...] = ()) -> DataFrame:
    """seed, target, depth, path of a shortest path for each pair (D2); of several, the smallest by its nodes from the
    seed. Paths carry their nodes; a node is passed once, by its smallest shortest path."""
    step = oriented(edges, direction, kinds)
    level = pairs.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"))
    seen = level
    for _ in range(max_depth):
        ahead = level.join(step, level["node"] == step["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        level = ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.concat("before", F.array("node")).alias("path"))
        level = materialise(level, "paths", True)
        if not rows(level):
            break
        seen = seen.unionByName(level)
    return seen.join(pairs.select("seed", F.col("target").alias("node")), ["seed", "node"]).select("seed", F.col("node").alias("target"), (F.size("path") - 1).alias("depth"), "path")


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3, max_paths: int = 100, kinds: tuple[str, ...] = ()) -> DataFrame:
    """seed, target, path of simple paths, shortest first, at most max_paths a pair.

    A path is only carried on to nodes from which a target can be reached in the steps that are left."""
    step = oriented(edges, "out", kinds)
    near = front = pairs.select(F.col("target").alias("node")).distinct().withColumn("steps", F.lit(0))
    for i in range(1, max_depth):
        front = step.join(front, F.col("dst") == front["node"]).select(F.col("src").alias("node")).distinct().join(near, "node", "left_anti").withColumn("steps", F.lit(i))
        front = materialise(front, "path-ends", True)
        if not rows(front):
            break
        near = near.unionByName(front)
    level = pairs.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"))
    out = None
    for i in range(max_depth):
        ahead = step.join(near.where(F.col("steps") < max_depth - i), F.col("dst") == near["node"]).select("src", "dst")
        level = level.join(ahead, level["node"] == ahead["src"]).where(~F.array_contains("path", F.col("dst"))).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        level = materialise(level, "paths") if i < max_depth - 1 else level
        out = level if out is None else out.unionByName(level)
    hits = out.join(pairs.select("seed", F.col("target").alias("node")).distinct(), ["seed", "node"])
    place = F.row_number().over(Window.partitionBy("seed", "node").orderBy(F.size("path"), "path"))
    return hits.withColumn("_place", place).where(F.col("_place") <= max_paths).select("seed", F.col("node").alias("target"), "path")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, kinds: tuple[str, ...] = (), direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of the seeds, and the edges among them (D3)."""
    ids = bfs(edges, seeds, depth, direction, kinds).select(F.col("node").alias("id")).unionByName(seeds.select(F.col("seed").alias("id"))).distinct()
    rows = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    inside = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def match_pattern(nodes: DataFrame, edges: DataFrame, kinds: list[str | None], links: list[str], where: dict[int, str] | None = None) -> DataFrame:
    """Bindings n0, n1, ... of a chain of nodes of these kinds (None: any) joined by edges of these kinds (D4). where has, by
    place, conditions on the nodes' columns as SQL, like {1: "full_name = 'Weapon.Fire'"}."""
    of_kind = lambda i: nodes.where(F.col("kind") == kinds[i]) if kinds[i] else nodes
    at = lambda i: (of_kind(i).where((where or {}).get(i, "true"))).select(F.col("id").alias(f"n{i}"))
    found = at(0)
    for i, kind in enumerate(links):
        step = edges.where(F.col("kind") == kind).select(F.col("source_id").alias(f"n{i}"), F.col("target_id").alias(f"n{i + 1}"))
        found = found.join(step, f"n{i}").join(at(i + 1), f"n{i + 1}")
    return found.select(*[f"n{i}" for i in range(len(kinds))])


def count_below(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, n: how many nodes lead to each seed along edges of source_id and target_id, at any depth (0 is left out). In a
    forest they are the sizes of trees; else each pair is found."""
    try:
        found = forest_sizes(edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("parent")))
    except ValueError:
        return bfs(edges, seeds, None, "in").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return found.where("size > 1").select(F.col("node").alias("seed"), (F.col("size") - 1).alias("n")).join(seeds, "seed", "left_semi")


def match_graph(nodes: DataFrame, edges: DataFrame, kinds: dict[str, str | None], links: list[tuple[str, str, str]], where: dict[str, str] | None = None, apart: bool = True) -> DataFrame:
    """Bindings (a column for each name) of a pattern of any shape: chains, branches and closed ones.

    kinds has each name's node kind (None: any), links (from, kind, to), where a condition on a name's node columns as SQL.
    One link after the other extends the bindings by a join; a link whose ends are both bound is a semi-join, and is taken
    as soon as it can be. apart: different names are different nodes. For triangles of undirected edges see triangles().
    """
    of_kind = lambda v: (nodes.where(F.col("kind") == kinds[v]) if kinds[v] else nodes).where((where or {}).get(v, "true")).select(F.col("id").alias(v))
    step = lambda a, kind, b: edges.where(F.col("kind") == kind).select(F.col("source_id").alias(a), F.col("target_id").alias(b)).distinct()
    left, found = list(links), of_kind(links[0][0])
    bound = {links[0][0]}
    while left:
        link = min(left, key=lambda x: (-len({x[0], x[2]} & bound), left.index(x)))
        left.remove(link)
        a, kind, b = link
        ends = {a, b} & bound
        if not ends:
            raise ValueError("the pattern has several parts")
        if a == b:
            found = found.join(edges.where((F.col("kind") == kind) & (F.col("source_id") == F.col("target_id"))).select(F.col("source_id").alias(a)), a, "left_semi")
            continue
        if len(ends) == 2:
            found = found.join(step(a, kind, b), [a, b], "left_semi")
            continue
        new = b if a in bound else a
        found = found.join(step(a, kind, b), list(ends)).join(of_kind(new), new)
        if apart:
            for other in bound:
                found = found.where(F.col(other) != F.col(new))
        bound.add(new)
    return found.select(*kinds)


def triangles(edges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """A < b < c of each three nodes that are joined pairwise, whatever the direction.

    Each edge goes from the end of fewer edges to that of more, so a node has at most some square root of all edges ahead of
    it, and a hub's neighbours are not paired with one another; pairs of what is ahead of a node are kept if an edge closes
    them."""
    ways = oriented(edges, "out", kinds).where("src != dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    ways = materialise(ways, "triangle-edges")
    degree = ways.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    x, y = (degree.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n")) for c in "xy")
    up = F.struct("x_n", "x") < F.struct("y_n", "y")
    ahead = ways.join(x, "x").join(y, "y").select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("low"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("high"))
    ahead = materialise(ahead, "triangle-ahead")
    wedges = ahead.select("low", F.col("high").alias("one")).join(ahead.select("low", F.col("high").alias("two")), "low").where("one < two")
    closed = wedges.join(ways.select(F.col("x").alias("one"), F.col("y").alias("two")), ["one", "two"], "left_semi")
    corners = F.array_sort(F.array("low", "one", "two"))
    return closed.select(*[F.get(corners, F.lit(i)).alias(c) for i, c in enumerate("abc")])


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank (D5): ranks start at 1/N; what nodes without targets hold is not handed on."""
    step = materialise(oriented(edges, "out"), "rank-edges")
    degree = step.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out = materialise(step.join(degree, "src"), "rank-out")
    nodes = materialise(step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct(), "rank-nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(rounds):
        given = out.join(ranks, out["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        ranks = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            ranks = materialise(ranks, "ranks")
    return ranks


def reference_scores(edges: DataFrame) -> DataFrame:
    """node, incoming, score ln(1 + incoming)."""
    return edges.groupBy(F.col("target_id").alias("node")).agg(F.count(F.lit(1)).alias("incoming")).withColumn("score", F.log1p(F.col("incoming")))


def distance_scores(found: DataFrame) -> DataFrame:
    """node, score: the sum of 1/(1+depth) over the seeds that reach it (D5); combine() weighs it."""
    return found.groupBy("node").agg(F.sum(1 / (1 + F.col("depth"))).alias("score"))


def combine(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """node, score: the weighted sum of several (node, score) tables, a missing one counting 0."""
    rows = None
    for df, weight in parts.values():
        one = df.select("node", (F.col("score") * weight).alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("node").agg(F.sum("score").alias("score"))


def expand_relevance(edges: DataFrame, seeds: DataFrame, weights: dict[str, float], depth: int = 2, decay: float = 0.5, incoming: float = 0.8) -> DataFrame:
    """node, score: the best product of the seeds' scores, edge weights and the decay a step; against an edge's direction
    a step counts less (D11)."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(0.0))
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), weight.alias("w"))
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), (weight * incoming).alias("w"))
    step = out.unionByName(back).groupBy("src", "dst").agg(F.max("w").alias("w"))
    level = seeds.select(F.col("seed").alias("node"), "score")
    every = level
    for _ in range(depth):
        level = level.join(step, level["node"] == step["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("w") * decay).alias("score"))
        every = every.unionByName(level)
    return every.groupBy("node").agg(F.max("score").alias("score"))
