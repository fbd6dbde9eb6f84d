"""Queries over symbols, nodes and edges: lookups, predicates, upserts, counts, comparison and health."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.operators import analysis, tables
from symgraph.plans import adapters as A
from symgraph.plans.adapters import DECLARES, FILES, NODES, SYMBOLS, with_ctes
from symgraph.registry import query
from symgraph.session import table

WANTED = ("red bolt", "RED BOLT", "NATION_7", "global::ASIA", "ASIA.NATION_2", "Supplier#000000003", "supplier#000000004", "Customer#00000001", "olt", "nothing here")
WANTED_SQL = "asked(query) AS (VALUES " + ", ".join(f"('{w}')" for w in WANTED) + ")"


def asked(spark):
    return spark.createDataFrame([(w,) for w in WANTED], "query string")


@query(with_ctes("SELECT id, full_name, kind FROM symbols WHERE name = 'red bolt'", SYMBOLS))
def symbol_by_name(spark, d):
    return tables.by_name(A.symbols(spark, d), "red bolt").select("id", "full_name", "kind")


@query(with_ctes("SELECT id, name, full_name FROM symbols WHERE id = md5('global::EUROPE.NATION_3') OR full_name = 'global::ASIA'", SYMBOLS))
def symbol_by_key(spark, d):
    s = A.symbols(spark, d)
    found = tables.by_id(s, hashlib.md5(b"global::EUROPE.NATION_3").hexdigest()).unionByName(tables.by_full_name(s, "global::ASIA"))
    return found.select("id", "name", "full_name")


@query(with_ctes("SELECT id, name, repository FROM symbols WHERE kind = 'Type'", SYMBOLS))
def symbol_by_kind(spark, d):
    return tables.by_kind(A.symbols(spark, d), "Type").select("id", "name", "repository")


@query(with_ctes("SELECT id, name, kind FROM symbols WHERE coalesce(container_id, declaring_type_id) = md5('global::EUROPE.NATION_3')", SYMBOLS))
def symbol_by_container(spark, d):
    return tables.by_container(A.symbols(spark, d), hashlib.md5(b"global::EUROPE.NATION_3").hexdigest()).select("id", "name", "kind")


@query("SELECT e.user_id, e.event_id, e.event_type, e.value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) e WHERE n = 1")
def symbol_upsert_latest(spark, d):
    rows = table(spark, d, "events").withColumn("id", F.col("event_id"))
    return tables.latest(rows, ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


@query("SELECT p_partkey, p_name, p_retailprice * 2 AS price FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <= 25")
def symbol_upsert_merge(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"), "p_size")
    new = old.where("p_size > 25").withColumn("price", F.col("price") * 2)
    return tables.upsert(old, new, ["p_partkey"]).select("p_partkey", "p_name", "price")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def symbol_remove(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return tables.remove(table(spark, d, "part"), gone, "p_partkey").select("p_partkey", "p_name")


RESOLVE = """tiers AS (SELECT query, s.*, 0 AS tier FROM symbols s JOIN asked ON full_name = query UNION ALL SELECT query, s.*, 1 FROM symbols s JOIN asked ON name = query
 UNION ALL SELECT query, s.*, 2 FROM symbols s JOIN asked ON lower(name) = lower(query)),
loose AS (SELECT query, s.*, CASE WHEN starts_with(lower(name), lower(query)) THEN 3 ELSE 4 END AS tier FROM symbols s JOIN asked ON contains(lower(name), lower(query)) OR contains(lower(full_name), lower(query)) WHERE query NOT IN (SELECT query FROM tiers))"""
RESOLVED = """SELECT query, full_name, kind, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE kind WHEN 'Type' THEN 0 WHEN 'Method' THEN 1 ELSE 2 END, full_name, id) AS n FROM (FROM tiers UNION ALL FROM loose)) WHERE n = 1"""


@query(with_ctes(RESOLVED, SYMBOLS, WANTED_SQL, RESOLVE))
def resolve_symbol(spark, d):
    return tables.resolve(A.symbols(spark, d), asked(spark)).select("query", "full_name", "kind", "tier")


@query(
    with_ctes(
        """SELECT query, full_name, kind, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, kind = 'Type' DESC, kind = 'Method' DESC, starts_with(full_name, 'global::') DESC, full_name, id) AS n FROM (
SELECT query, s.*, 0 AS tier FROM symbols s JOIN asked ON full_name = query OR full_name = 'global::' || query OR name = query UNION ALL SELECT query, s.*, 1 FROM symbols s JOIN asked ON lower(name) = lower(query) WHERE kind = 'Type')) WHERE n = 1""",
        SYMBOLS,
        WANTED_SQL,
    )
)
def resolve_symbol_ranked(spark, d):
    return tables.resolve_ranked(A.symbols(spark, d), asked(spark)).select("query", "full_name", "kind", "tier")


@query(with_ctes("SELECT id, name, total FROM (SELECT id, name, full_name, count(*) OVER () AS total FROM symbols WHERE kind = 'Property' AND (contains(lower(name), 'bolt') OR contains(lower(full_name), 'bolt'))) ORDER BY name, full_name, id LIMIT 100", SYMBOLS))
def list_symbols(spark, d):
    return tables.list_symbols(A.symbols(spark, d), "property", "BOLT").select("id", "name", "total")


@query("SELECT page_id, url FROM pages WHERE NOT list_has_any(string_split(lower(replace(url, '\\', '/')), '/'), ['en', 'fr'])")
def path_exclude(spark, d):
    from symgraph.functions.text import segments_outside

    return table(spark, d, "pages").where(segments_outside(F.col("url"), ["EN", "fr"])).select("page_id", "url")


@query(with_ctes("SELECT (SELECT count(*) FROM nodes WHERE repository NOT IN ('ASIA', 'EUROPE')) AS nodes, (SELECT count(*) FROM declares WHERE repository NOT IN ('ASIA', 'EUROPE')) AS edges", SYMBOLS, NODES, DECLARES))
def project_filter_graph(spark, d):
    n, e = tables.hidden_projects(A.nodes(spark, d), A.declares(spark, d), ["asia", "Europe"])
    return n.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))


@query(with_ctes("SELECT id, label, kind FROM nodes WHERE kind IN ('Class', 'Property') AND (contains(lower(label), 'ring') OR contains(lower(kind), 'ring'))", SYMBOLS, NODES))
def search_nodes(spark, d):
    return tables.search_nodes(A.nodes(spark, d), "RING", ["Class", "Property"]).select("id", "label", "kind")


@query(with_ctes("SELECT source_id, target_id FROM declares WHERE source_id NOT IN (SELECT id FROM nodes WHERE label LIKE '%1') AND target_id NOT IN (SELECT id FROM nodes WHERE label LIKE '%1')", SYMBOLS, NODES, DECLARES))
def node_cascade_delete(spark, d):
    n = A.nodes(spark, d)
    return tables.remove_nodes(n, A.declares(spark, d), n.where("label like '%1'"))[1].select("source_id", "target_id")


@query(with_ctes("SELECT n.id, n.label, n.kind FROM nodes n WHERE label LIKE 'NATION%' UNION ALL SELECT DISTINCT target_id, target_id, 'External' FROM declares", SYMBOLS, NODES, DECLARES))
def graph_placeholders(spark, d):
    n = A.nodes(spark, d).where("label like 'NATION%'").select("id", "label", "kind")
    return tables.with_placeholders(n, A.declares(spark, d)).select("id", "label", "kind")


@query("SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, CASE l_returnflag WHEN 'R' THEN 'Calls' ELSE 'Uses' END AS kind FROM lineitem")
def edge_dedupe(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "Calls").otherwise("Uses")
    return tables.distinct_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), kind.alias("kind")))


@query(with_ctes("SELECT target_id, kind FROM calls WHERE source_id = 17", A.CALLS))
def adjacency_out(spark, d):
    return tables.outgoing(A.calls(spark, d), 17, "Calls").select("target_id", "kind")


@query(with_ctes("SELECT source_id, kind FROM calls WHERE target_id = 17", A.CALLS))
def adjacency_in(spark, d):
    return tables.incoming(A.calls(spark, d), 17).select("source_id", "kind")


@query(with_ctes("SELECT source_id, count(DISTINCT target_id) AS n, list_sort(list(DISTINCT target_id))[1] AS least FROM calls GROUP BY source_id", A.CALLS))
def adjacency_sets(spark, d):
    return tables.adjacency(A.calls(spark, d)).select("source_id", "n", F.get("targets", 0).alias("least"))


@query(with_ctes("SELECT id, full_name FROM nodes", SYMBOLS.replace("md5('part:' || p_partkey::varchar)", "md5('global::' || p_brand || '.' || p_name)"), NODES))
def node_ids(spark, d):
    return A.nodes(spark, d).select(ids.node_id(F.col("full_name")).alias("id"), "full_name")


@query(with_ctes("SELECT source_id, target_id, md5(unhex(source_id || target_id || '07000000')) AS id FROM declares", SYMBOLS, DECLARES))
def edge_ids(spark, d):
    return A.declares(spark, d).select("source_id", "target_id", ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("id"))


@query("SELECT doc_id, to_base64(unhex(md5(text))) AS chunk_hash, to_base64(unhex(sha256(text))) AS file_hash, substr(sha256('Prefab:' || source), 1, 32) AS asset_id FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.text_hash(F.col("text")).alias("chunk_hash"), ids.file_hash(F.col("text")).alias("file_hash"), ids.asset_id("Prefab", F.col("source")).alias("asset_id"))


@query(with_ctes("SELECT kind, count(*) AS n FROM nodes GROUP BY kind", SYMBOLS, NODES))
def graph_stats(spark, d):
    return analysis.counts_by_kind(A.nodes(spark, d))


STATS = """SELECT repository, count(*) AS total, count(*) FILTER (kind = 'Type' AND type_name = 'Class') AS classes, count(*) FILTER (kind = 'Type' AND type_name = 'Interface') AS interfaces, count(*) FILTER (kind = 'Method') AS methods,
 count(*) FILTER (kind = 'Property') AS properties, count(*) FILTER (kind = 'Field') AS fields, count(*) FILTER (kind = 'Namespace') AS namespaces FROM symbols GROUP BY repository"""


@query(with_ctes(STATS, SYMBOLS))
def repo_stats(spark, d):
    return analysis.repository_stats(A.symbols(spark, d))


@query(with_ctes(f"SELECT sum(total)::bigint AS symbols, sum(classes)::bigint AS classes, sum(methods)::bigint AS methods, sum(properties)::bigint AS properties, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM declares) AS edges FROM ({STATS})", SYMBOLS, NODES, DECLARES))
def architecture_summary(spark, d):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    s = analysis.repository_stats(A.symbols(spark, d)).agg(F.sum("total").alias("symbols"), *[F.sum(c).alias(c) for c in ("classes", "methods", "properties")])
    return s.crossJoin(one(A.nodes(spark, d), "nodes")).crossJoin(one(A.declares(spark, d), "edges"))


@query(with_ctes("SELECT repository, count(DISTINCT name) AS names, list_sort(list(DISTINCT name))[1] AS first FROM symbols WHERE kind = 'Type' GROUP BY repository", SYMBOLS))
def namespaces(spark, d):
    return tables.by_kind(A.symbols(spark, d), "Type").groupBy("repository").agg(F.count_distinct("name").alias("names"), F.get(F.array_sort(F.collect_set("name")), 0).alias("first"))


@query(with_ctes("SELECT s.repository, s.id, s.name, m.n FROM symbols s JOIN (SELECT declaring_type_id AS owner, count(*) AS n FROM symbols GROUP BY 1) m ON m.owner = s.id WHERE s.kind = 'Type' AND m.n > 30", SYMBOLS))
def large_classes(spark, d):
    return analysis.large_classes(A.symbols(spark, d))


@query("SELECT s_suppkey AS id, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(*) > 590")
def god_classes(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Type").alias("kind"), F.lit("Class").alias("type_name"), F.lit("r").alias("repository"))
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.lit("Calls").alias("kind"))
    return analysis.god_classes(s, e, 590).select("id", "n")


DENSITY = """sizes AS (SELECT repository, count(*) AS nodes FROM nodes GROUP BY repository), links AS (SELECT repository, count(*) AS edges FROM declares GROUP BY repository)"""


@query(with_ctes("SELECT repository, nodes, coalesce(edges, 0) AS edges, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0)::double / (nodes::double * (nodes - 1) / 2) ELSE 0 END, 9) AS density, round(coalesce(edges, 0)::double / nodes, 9) AS average FROM sizes LEFT JOIN links USING (repository)", SYMBOLS, NODES, DECLARES, DENSITY))
def graph_density(spark, d):
    n, e = A.nodes(spark, d).groupBy("repository").agg(F.count(F.lit(1)).alias("nodes")), A.declares(spark, d).groupBy("repository").agg(F.count(F.lit(1)).alias("edges"))
    rows = n.join(e, "repository", "left").fillna(0, ["edges"])
    return rows.select("repository", "nodes", "edges", F.round(analysis.density(F.col("nodes"), F.col("edges")), 9).alias("density"), F.round(F.try_divide(F.col("edges").cast("double"), F.col("nodes")), 9).alias("average"))


HEALTH = """uses AS (SELECT DISTINCT s.declaring_type_id AS source_id, md5('part:' || l_partkey::varchar) AS target_id, 'Uses' AS kind, s.repository FROM lineitem JOIN symbols s ON s.kind = 'Method' AND s.name = 'Supplier#' || lpad(l_suppkey::varchar, 9, '0')),
loops AS (SELECT a.id AS source_id, b.id AS target_id, 'Inherits' AS kind, a.repository FROM nodes a, nodes b WHERE (a.label, b.label) IN (('NATION_3', 'NATION_8'), ('NATION_8', 'NATION_3'), ('NATION_4', 'NATION_3'), ('NATION_8', 'NATION_1'), ('NATION_1', 'NATION_18'), ('NATION_18', 'NATION_23'), ('NATION_23', 'NATION_18'))),
links AS (FROM declares UNION ALL FROM uses UNION ALL FROM loops),
large AS (SELECT s.repository, count(*) AS n FROM symbols s JOIN (SELECT declaring_type_id AS owner, count(*) AS n FROM symbols GROUP BY 1) m ON m.owner = s.id WHERE s.kind = 'Type' AND m.n > 30 GROUP BY 1),
god AS (SELECT s.repository, count(*) AS n FROM symbols s JOIN (SELECT source_id, count(*) AS n FROM links WHERE kind IN ('Calls', 'Uses') GROUP BY 1) m ON m.source_id = s.id WHERE s.kind = 'Type' AND m.n > 20 GROUP BY 1),
cyclic AS (SELECT repository, 1 AS n FROM nodes WHERE label IN ('NATION_3', 'NATION_8') GROUP BY 1),
dense AS (SELECT repository, nodes, coalesce(edges, 0)::double / (nodes::double * (nodes - 1) / 2) AS density FROM (SELECT repository, count(*) AS nodes FROM nodes GROUP BY 1) LEFT JOIN (SELECT repository, count(*) AS edges FROM links GROUP BY 1) USING (repository))"""


@query(
    with_ctes(
        """SELECT repository, greatest(0, least(100, 100 - 5 * n_large - 15 * n_cycle - 10 * n_god - CASE WHEN density > 0.5 THEN 5 ELSE 0 END))::double AS score, total, n_large, n_god, n_cycle, round(density, 9) AS density
FROM (SELECT t.repository, t.total, coalesce(l.n, 0) AS n_large, coalesce(g.n, 0) AS n_god, coalesce(c.n, 0) AS n_cycle, d.density FROM (SELECT repository, count(*) AS total FROM symbols GROUP BY 1) t
LEFT JOIN large l USING (repository) LEFT JOIN god g USING (repository) LEFT JOIN cyclic c USING (repository) LEFT JOIN dense d USING (repository))""",
        SYMBOLS, NODES, DECLARES, HEALTH,
    )
)
def health_score(spark, d):
    """Classes use the parts that their suppliers deliver, and two inherit from one another."""
    s, n = A.symbols(spark, d), A.nodes(spark, d)
    line = table(spark, d, "lineitem").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("name"), ids.node_id(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("target_id"))
    uses = line.join(s.where("kind = 'Method'"), "name").select(F.col("declaring_type_id").alias("source_id"), "target_id", F.lit("Uses").alias("kind"), "repository").distinct()
    pairs = spark.createDataFrame([("NATION_3", "NATION_8"), ("NATION_8", "NATION_3"), ("NATION_4", "NATION_3"), ("NATION_8", "NATION_1"), ("NATION_1", "NATION_18"), ("NATION_18", "NATION_23"), ("NATION_23", "NATION_18")], "a string, b string")
    end = lambda k, name: n.select(F.col("label").alias(k), F.col("id").alias(name), F.col("repository").alias(f"{k}_repository"))
    loops = pairs.join(end("a", "source_id"), "a").join(end("b", "target_id"), "b").select("source_id", "target_id", F.lit("Inherits").alias("kind"), F.col("a_repository").alias("repository"))
    rows = analysis.health(s, n, A.declares(spark, d).unionByName(uses).unionByName(loops))
    return rows.select("repository", "score", "total", "n_large", "n_god", "n_cycle", F.round("density", 9).alias("density"))


COMPARE = """one AS (SELECT DISTINCT full_name AS n FROM (SELECT 'x.' || p_name AS full_name FROM part WHERE p_brand = 'Brand#3')), two AS (SELECT DISTINCT 'x.' || p_name AS n FROM part WHERE p_brand = 'Brand#7')"""


def _brands(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("repository"), F.concat(F.lit("x."), "p_name").alias("full_name"), F.col("p_type").alias("kind"))


@query(with_ctes("SELECT coalesce(one.n, two.n) AS full_name, CASE WHEN one.n IS NULL THEN 'UniqueToSecond' WHEN two.n IS NULL THEN 'UniqueToFirst' ELSE 'Common' END AS status FROM one FULL JOIN two ON one.n = two.n", COMPARE))
def repo_compare(spark, d):
    return analysis.compare(_brands(spark, d), "Brand#3", "Brand#7").select("full_name", "status")


@query(with_ctes("SELECT count(*) FILTER (one.n IS NOT NULL AND two.n IS NOT NULL) AS common, count(*) FILTER (two.n IS NULL) AS unique_one, count(*) FILTER (one.n IS NULL) AS unique_two FROM one FULL JOIN two ON one.n = two.n", COMPARE))
def repo_compare_counts(spark, d):
    return analysis.compare_counts(_brands(spark, d), "Brand#3", "Brand#7")


@query(with_ctes("SELECT full_name, count(DISTINCT repository) AS repositories FROM (SELECT p_name AS full_name, p_brand AS repository FROM part) GROUP BY 1"))
def symbol_repo_count(spark, d):
    from symgraph.operators.search import repositories_of

    return repositories_of(table(spark, d, "part").select(F.col("p_name").alias("full_name"), F.col("p_brand").alias("repository")))


@query(with_ctes("SELECT file_path AS path FROM files UNION ALL SELECT file_path || '.new' FROM files", FILES))
def registry_paths(spark, d):
    """All paths are registered again in capitals, which adds none, and with a new ending."""
    from symgraph.sources.files import register_paths

    rows = A.files(spark, d).select(F.col("file_path").alias("path"))
    return register_paths(rows, rows.select(F.upper("path").alias("path")).unionByName(rows.select(F.concat("path", F.lit(".new")).alias("path"))))
