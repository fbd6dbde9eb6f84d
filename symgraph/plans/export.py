"""Exports: graph rows, Mermaid text and metrics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours by kind.
NODE_COLORS = {
    "Repository": "#f0883e", "Project": "#79c0ff", "Namespace": "#8b949e", "Class": "#58a6ff", "Interface": "#a371f7", "Struct": "#79c0ff", "Enum": "#f0883e", "Record": "#d2a8ff", "Method": "#3fb950", "Property": "#d29922", "Field": "#f85149", "Event": "#ffa657",
    "File": "#58a6ff", "Assembly": "#8b949e", "Package": "#8b949e", "MonoBehaviour": "#3fb950", "ScriptableObject": "#a371f7", "Editor": "#d29922", "GameObject": "#58a6ff", "Prefab": "#79c0ff", "Component": "#f85149",
}
EDGE_COLORS = {
    "Contains": "#30363d", "Calls": "#3fb950", "Inherits": "#58a6ff", "Implements": "#a371f7", "Overrides": "#d29922", "Declares": "#8b949e", "Uses": "#f0883e", "References": "#f85149", "DependsOn": "#8b949e", "Reads": "#79c0ff", "Writes": "#d29922", "Requires": "#f0883e",
    "Attribute": "#a371f7", "Returns": "#58a6ff", "Parameter": "#ffa657", "FieldType": "#f85149", "PropertyType": "#d29922", "EventHandler": "#3fb950", "ImplicitlyImplements": "#a371f7", "ChildOf": "#30363d", "InstanceOf": "#58a6ff", "AddressableRef": "#79c0ff",
    "UnityEvent": "#ffa657", "Coroutine": "#3fb950", "AssemblyDep": "#8b949e", "Component": "#f85149",
}


def color(kind: Column, colors: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in colors.items())), kind), F.lit(other))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """E16."""
    return nodes.select("id", "label", "kind", color(F.col("kind"), NODE_COLORS, "#8b949e").alias("color"), F.when(F.col("kind").isin("Class", "Interface"), 10).otherwise(5).alias("size"))


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' labels; an end that is missing is External(kind)."""
    end = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.coalesce("label", "full_name").alias(f"{s}_label"))
    rows = edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    other = F.concat(F.lit("External("), "kind", F.lit(")"))
    return rows.select("source_id", "target_id", F.coalesce("source_label", other).alias("source_label"), F.coalesce("target_label", other).alias("target_label"), "kind", color(F.col("kind"), EDGE_COLORS, "#30363d").alias("color"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def mermaid(nodes: DataFrame, edges: DataFrame, most_nodes: int = 50, most_edges: int = 100, node_kinds: tuple[str, ...] = ("Class", "Interface", "Method"), edge_kinds: tuple[str, ...] = ("Inherits", "Implements", "Calls")) -> DataFrame:
    """One row: the text of a diagram. ids are cut to 8 characters; kinds come in the order given."""
    order = lambda kinds: F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    n = nodes.where(F.col("kind").isin(*node_kinds)).orderBy(order(node_kinds), "full_name", "id").limit(most_nodes)
    n = n.select(F.struct(F.lit(0).alias("a"), order(node_kinds).alias("b"), F.col("full_name").alias("c"), F.col("id").alias("d")).alias("o"), F.concat(F.lit("    "), F.substring("id", 1, 8), F.lit('["'), "label", F.lit('"]')).alias("t"))
    e = edges.where(F.col("kind").isin(*edge_kinds)).orderBy(order(edge_kinds), "source_id", "target_id").limit(most_edges)
    e = e.select(F.struct(F.lit(1).alias("a"), order(edge_kinds).alias("b"), F.col("source_id").alias("c"), F.col("target_id").alias("d")).alias("o"), F.concat(F.lit("    "), F.substring("source_id", 1, 8), F.lit(" --> "), F.substring("target_id", 1, 8)).alias("t"))
    lines = n.unionByName(e).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("x"))
    return lines.select(F.array_join(F.concat(F.array(F.lit("graph TD")), F.transform("x", lambda r: r["t"])), "\n").alias("mermaid"))


# How edges are drawn, and what marks a kind of node.
ARROWS = {"Inherits": "-->|inherits|", "Implements": "-.->|implements|", "Requires": "-->|requires|", "References": "-.->|references|"}
MARKS = {"Interface": ("interface", "#e1f5fe"), "MonoBehaviour": ("monoBehaviour", "#c8e6c9")}


def diagram(nodes: DataFrame, edges: DataFrame, way: str = "TD") -> DataFrame:
    """One row: a diagram of these nodes and of the edges among them, for call graphs, hierarchies, dependencies (way LR),
    components and architectures, as the caller picks nodes and edges; nodes by full name, edges by their ends."""
    mark = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(f":::{m}")) for k, (m, _) in MARKS.items())), F.col("kind")), F.lit(""))
    arrow = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(a)) for k, a in ARROWS.items())), F.col("kind")), F.lit("-->"))
    line = lambda order, t: F.struct(*[x.cast("string").alias(f"o{i}") for i, x in enumerate(order)], t.alias("t"))
    n = nodes.select(line((F.lit(0), F.col("full_name"), F.col("id"), F.lit("")), F.concat(F.lit("    "), F.col("id").cast("string"), F.lit('["'), "label", F.lit('"]'), mark)).alias("x"), F.array_intersect(F.array(F.col("kind")), F.array(*map(F.lit, MARKS))).alias("marks"))
    ends = nodes.select("id")
    inside = edges.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    e = inside.select(line((F.lit(1), F.col("source_id"), F.col("target_id"), F.col("kind")), F.concat(F.lit("    "), F.col("source_id").cast("string"), F.lit(" "), arrow, F.lit(" "), F.col("target_id").cast("string"))).alias("x"), F.array().cast("array<string>").alias("marks"))
    rows = n.unionByName(e).agg(F.array_sort(F.collect_list("x")).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"))
    styles = F.transform("marks", lambda k: F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(f"    classDef {m} fill:{c}")) for k, (m, c) in MARKS.items())), k))
    return rows.select(F.array_join(F.concat(F.array(F.lit(f"graph {way}")), F.transform("lines", lambda r: r["t"]), styles), "\n").alias("mermaid"))


def prometheus(metrics: DataFrame, prefix: str = "symgraph") -> DataFrame:
    """One line for each (name, value)."""
    return metrics.select(F.concat(F.lit(f"{prefix}_"), F.replace("name", F.lit("."), F.lit("_")), F.lit(" "), F.format_string("%.2f", F.col("value").cast("double"))).alias("line"))
