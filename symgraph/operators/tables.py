"""Point lookups, predicates, upserts and removals on the canonical tables, and resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import contains_ci
from symgraph.session import broadcast_if, materialise, rows

TIE = ("full_name", "id")


def latest(rows: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Upsert: the newest row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *[c for c in TIE if c in rows.columns and c not in keys]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new beside those rows of old that it doesn't replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remove(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in gone (id), and edges without those that touch them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def by_id(symbols: DataFrame, x: str) -> DataFrame:
    """P2."""
    return symbols.where(F.col("id") == x)


def by_full_name(symbols: DataFrame, x: str) -> DataFrame:
    """The first symbol of this full name."""
    return symbols.where(F.col("full_name") == x).orderBy("id").limit(1)


def by_name(symbols: DataFrame, x: str) -> DataFrame:
    """P4, H9."""
    return symbols.where(F.col("name") == x)


def by_kind(rows: DataFrame, *kinds: str) -> DataFrame:
    """P5, O1, K5, and by kind of nodes and edges."""
    return rows.where(F.col("kind").isin(*kinds))


def by_file(symbols: DataFrame, path: str) -> DataFrame:
    """P6."""
    return symbols.where(F.col("file_path") == path)


def by_container(symbols: DataFrame, x: str, container_only: bool = False) -> DataFrame:
    """P7; members count too unless container_only."""
    return symbols.where((F.col("container_id") if container_only else F.coalesce("container_id", "declaring_type_id")) == x)


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    """P12."""
    return nodes.where(F.try_element_at("metadata", F.lit("FilePath")) == path)


def references_of(refs: DataFrame, symbol: str, definition: tuple[str, int] | None = None) -> DataFrame:
    """P8, H6; without the definition's own place if it is given."""
    found = refs.where(F.col("symbol_id") == symbol)
    return found if definition is None else found.where(~((F.col("file_path") == definition[0]) & (F.col("line") == definition[1])))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Set semantics of edges."""
    return edges.dropDuplicates(["source_id", "target_id", "kind"])


def outgoing(edges: DataFrame, x: str, *kinds: str) -> DataFrame:
    """P14."""
    return (by_kind(edges, *kinds) if kinds else edges).where(F.col("source_id") == x)


def incoming(edges: DataFrame, x: str, *kinds: str) -> DataFrame:
    """P14."""
    return (by_kind(edges, *kinds) if kinds else edges).where(F.col("target_id") == x)


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted sets of targets of each source."""
    return edges.groupBy("source_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"), F.count_distinct("target_id").alias("n"))


def _picked(candidates: DataFrame, order: list[Column]) -> DataFrame:
    return candidates.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where("_place = 1").drop("_place")


def resolve(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's symbol by full name, then name (a Type, else a Method, else any), then equal but for case, then
    beginning with or containing the query (P9). All queries are answered in one pass; tiers are equi-joins, the last one by
    the unanswered queries' rarest grams, verified."""
    from symgraph.operators.search import containing

    q = materialise(queries.select("query").distinct(), "queries", True)
    kind = F.when(F.col("kind") == "Type", 0).when(F.col("kind") == "Method", 1).otherwise(2)
    way = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("_key"))
    offered = symbols.select(*symbols.columns, F.inline(F.array(way(0, F.col("full_name")), way(1, F.col("name")), way(2, F.lower("name")))))
    wanted = q.select("query", F.inline(F.array(way(0, F.col("query")), way(1, F.col("query")), way(2, F.lower("query")))))
    near = materialise(offered.join(broadcast_if(wanted, 100_000), ["tier", "_key"]).drop("_key"), "resolved")
    rest = materialise(q.join(near.select("query").distinct(), "query", "left_anti"), "unresolved", True)
    if not rows(rest):
        return _picked(near, [F.col("tier"), kind, F.col("full_name"), F.col("id")])
    keyed = symbols.withColumn("_key", F.xxhash64("id", "name", "full_name"))
    may = materialise(containing(keyed, F.concat_ws("\n", "name", "full_name"), rest), "name-candidates", True)
    loose = keyed.join(broadcast_if(may, 100_000), "_key").where(contains_ci(F.col("name"), F.col("query")) | contains_ci(F.col("full_name"), F.col("query"))).drop("_key").withColumn("tier", F.when(F.startswith(F.lower("name"), F.lower("query")), 3).otherwise(4))
    return _picked(near.unionByName(loose), [F.col("tier"), kind, F.col("full_name"), F.col("id")])


def resolve_ranked(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's symbol among those of this full name, with global:: before it or not, or of this name; if none, the
    first Type of equal name but for case. Types first, then Methods, then names with global:: (P10)."""
    q = queries.select("query").distinct()
    spelled = q.select("query", F.explode(F.array(F.col("query"), F.concat(F.lit("global::"), F.col("query")))).alias("spelling"))
    full = symbols.join(spelled, symbols["full_name"] == spelled["spelling"]).drop("spelling")
    near = full.unionByName(symbols.join(q, symbols["name"] == q["query"])).withColumn("tier", F.lit(0))
    types = symbols.where("kind = 'Type'")
    loose = types.join(q, F.lower(types["name"]) == F.lower(q["query"])).withColumn("tier", F.lit(1))
    order = [F.col("tier"), F.desc(F.col("kind") == "Type"), F.desc(F.col("kind") == "Method"), F.desc(F.startswith("full_name", F.lit("global::"))), F.col("full_name"), F.col("id")]
    return _picked(near.unionByName(loose), order)


# What a kind asks for.
KIND_NAMES = {"class": "Type", "type": "Type", "interface": "Type", "struct": "Type", "enum": "Type", "method": "Method", "property": "Property", "field": "Field", "event": "Event", "namespace": "Namespace"}


def list_symbols(symbols: DataFrame, kind: str | None = None, name: str | None = None, most: int = 100) -> DataFrame:
    """Symbols of a kind whose name or full name contains name, by name, with the number of all."""
    rows = by_kind(symbols, KIND_NAMES[kind.lower()]) if kind and kind.lower() in KIND_NAMES else by_kind(symbols, "Type", "Method", "Property", "Field", "Event")
    if kind and kind.lower() in ("interface", "struct", "enum"):
        rows = rows.where(F.lower("type_name") == kind.lower())
    if name:
        rows = rows.where(contains_ci(F.col("name"), F.lit(name)) | contains_ci(F.col("full_name"), F.lit(name)))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("name", *TIE).limit(most).crossJoin(total)  # with one row


def hidden_projects(nodes: DataFrame, edges: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes whose metadata name one of the projects, and without their edges."""
    text = F.lower(F.concat_ws(" ", F.map_values("metadata")))
    off = F.lit(False)
    for n in names:
        off = off | F.contains(text, F.lit(n.lower()))
    return remove_nodes(nodes, edges, nodes.where(F.coalesce(off, F.lit(False))))


def search_nodes(nodes: DataFrame, part: str, kinds: list[str] | None = None) -> DataFrame:
    """Visible nodes whose label or kind contains part."""
    rows = nodes.where(F.col("kind").isin(kinds)) if kinds is not None else nodes
    return rows.where(contains_ci(F.col("label"), F.lit(part)) | contains_ci(F.col("kind"), F.lit(part)))


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and an External one for each end of an edge that is missing."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    missing = ends.join(nodes, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit("External").alias("kind"))
    return nodes.unionByName(missing, allowMissingColumns=True)
