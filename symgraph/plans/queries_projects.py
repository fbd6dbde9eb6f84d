"""Queries over scans, projects, Unity assets, paths and transitive relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.functions import ids, text
from symgraph.operators import graph, retrieval, search, tables
from symgraph.plans import adapters as A
from symgraph.plans.adapters import CALLS, FILES, INHERITS, NODES, REFS, SYMBOLS, with_ctes
from symgraph.plans.queries_graph import IMPACT, _impact, _walk
from symgraph.plans.queries_search import ASKED_SQL, GRAMS, asked
from symgraph.plans.queries_sources import SCENES, _scenes
from symgraph.registry import query
from symgraph.session import shared_path, table
from symgraph.sources import files as S
from symgraph.sources import unity


def _asset(prefix: str, *parts: str) -> str:
    """ids.asset_id in SQL."""
    return f"substr(sha256('{prefix}:' || " + " || ':' || ".join(parts) + "), 1, 32)"


@query("SELECT strlen(n_name) + 1 AS size, to_base64(unhex(sha256(n_name || chr(10)))) AS hash, 2 AS line_count, n_name || chr(10) AS content FROM nation")
def scan_files(spark, d):
    """A file a nation, written and scanned again."""
    path = shared_path(spark, "scan")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return S.scan(spark, path, (".txt",)).select("size", "hash", "line_count", "content")


def _by_region(spark, d, line):
    """One text a region, of a line a nation."""
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))


@query("SELECT r_name || '.sln' AS file_path, 'src\\' || n_name || '\\' || n_name || '.csproj' AS project FROM nation JOIN region ON n_regionkey = r_regionkey")
def solution_projects(spark, d):
    line = F.concat(F.lit('Project("{A}") = "'), "n_name", F.lit('", "src\\'), "n_name", F.lit("\\"), "n_name", F.lit('.csproj", "{B}"\nEndProject'))
    return S.solution_projects(_by_region(spark, d, line).select(F.concat("r_name", F.lit(".sln")).alias("file_path"), F.lit(".sln").alias("ext"), "content"))


@query("SELECT 'src/' || n_name || '/p.csproj' AS project, 'src/' || n_name AS dir, CASE WHEN n_nationkey % 2 = 0 THEN 'net' || n_nationkey || '.0' ELSE 'net10.0' END AS target_framework FROM nation")
def projects(spark, d):
    framework = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<TargetFramework>net"), F.col("n_nationkey").cast("string"), F.lit(".0</TargetFramework>"))).otherwise("<Nullable>enable</Nullable>")
    content = F.concat(F.lit("<Project><PropertyGroup>"), framework, F.lit("</PropertyGroup></Project>"))
    return S.projects(table(spark, d, "nation").select(F.concat(F.lit("src/"), "n_name", F.lit("/p.csproj")).alias("file_path"), F.lit(".csproj").alias("ext"), content.alias("content")))


@query(with_ctes("SELECT file_path, CASE WHEN length(repository) % 2 = 0 THEN repository || '/p.csproj' ELSE (SELECT min(repository || '/p.csproj') FROM files WHERE length(repository) % 2 = 0) END AS project FROM files", FILES))
def owning_projects(spark, d):
    """Every other source is a project's folder; the rest go to the first project."""
    f = A.files(spark, d)
    found = f.where("length(repository) % 2 = 0").select(F.concat("repository", F.lit("/p.csproj")).alias("project"), F.col("repository").alias("dir")).distinct()
    return S.owning_project(f, found).select("file_path", "project")


@query(with_ctes("SELECT doc_id, file_path FROM files WHERE file_path = (SELECT file_path FROM files WHERE doc_id = 3)", FILES))
def symbol_by_file(spark, d):
    f = A.files(spark, d)
    return tables.by_file(f, f.where("doc_id = 3").first()["file_path"]).select("doc_id", "file_path")


@query(with_ctes("SELECT id, label FROM nodes WHERE repository = 'ASIA'", SYMBOLS, NODES))
def nodes_by_file(spark, d):
    return tables.nodes_by_file(A.nodes(spark, d), "ASIA.cs").select("id", "label")


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS file, CASE WHEN regexp_matches(url, '\\.[^./]+$') THEN lower(regexp_extract(url, '\\.[^./]+$')) ELSE '' END AS ext, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    whole = F.concat(text.stem(u), F.regexp_extract(u, r"(\.[^./\\]*)$", 1))
    return table(spark, d, "pages").select("page_id", whole.alias("file"), text.extension(u).alias("ext"), text.dirname(u).alias("folder"))


@query(with_ctes("SELECT query, id, overlap, graded FROM fuzzy", SYMBOLS, ASKED_SQL, GRAMS))
def find_symbol_fuzzy_indexed(spark, d):
    s = A.symbols(spark, d)
    return search.by_trigrams(s, asked(spark), index=search.trigram_index(s)).withColumn("graded", F.round("graded", 9))


@query(
    with_ctes(
        "SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2", CALLS, INHERITS, REFS, IMPACT, "seeds(seed) AS (VALUES ('c1'), ('PROMO'))", "below AS (SELECT * FROM links WHERE kind IN ('Implements', 'Inherits'))", _walk("seeds", "t", "s", "below", 60),
    )
)
def implementations_transitive(spark, d):
    seeds = spark.createDataFrame([("c1",), ("PROMO",)], "seed string")
    return graph.implementations(_impact(spark, d)[1], seeds, transitive=True).select("seed", "node", "depth")


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2", "seeds(seed) AS (VALUES (77::bigint), (140::bigint))", INHERITS, _walk("seeds", "source_id", "target_id", "inherits", 60)))
def dependencies(spark, d):
    seeds = spark.createDataFrame([(77,), (140,)], "seed long")
    return graph.dependencies(A.inherits(spark, d).withColumn("kind", F.lit("DependsOn")), seeds).select("seed", "node", "depth")


@query(with_ctes("SELECT seed, node, min(depth) AS depth FROM walk GROUP BY 1, 2", "seeds(seed) AS (VALUES (3::bigint), (4::bigint))", INHERITS, _walk("seeds", "target_id", "source_id", "inherits", 60)))
def overrides_recursive(spark, d):
    seeds = spark.createDataFrame([(3,), (4,)], "seed long")
    return graph.overrides(A.inherits(spark, d).withColumn("kind", F.lit("Overrides")), seeds, recursive=True).select("seed", "node", "depth")


@query("SELECT DISTINCT model, CASE WHEN contains(model, 'mxbai') OR contains(model, 'bge-m3') THEN 1024 ELSE 768 END AS dimension FROM (SELECT CASE conv_id % 3 WHEN 0 THEN 'mxbai-' WHEN 1 THEN 'x/bge-m3:' ELSE 'nomic-' END || role AS model FROM conversations)")
def model_dimensions(spark, d):
    k = F.col("conv_id") % 3
    model = F.concat(F.when(k == 0, "mxbai-").when(k == 1, "x/bge-m3:").otherwise("nomic-"), "role").alias("model")
    return table(spark, d, "conversations").select(model).distinct().select("model", retrieval.model_dimension(F.col("model")).alias("dimension"))


# Unity ------------------------------------------------------------------------------------------------------------------


@query("SELECT source AS repository, bool_or(doc_id % 3 = 0) AND bool_or(doc_id % 7 = 1 AND source != 'web') AS unity FROM documents GROUP BY source")
def unity_projects(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, "x/Assets/").otherwise("x/y/")
    rows = table(spark, d, "documents")
    one = rows.select(F.col("source").alias("repository"), F.concat(folder, k.cast("string")).alias("file_path"))
    two = rows.where((k % 7 == 1) & (F.col("source") != "web")).select(F.col("source").alias("repository"), F.concat(F.lit("ProjectSettings/"), k.cast("string")).alias("file_path"))
    return unity.is_project(one.unionByName(two))


@query(with_ctes("SELECT file_path AS id, doc_id % 3 = 0 AS is_mono, doc_id % 5 = 0 AS is_scriptable, doc_id % 7 = 0 AS is_editor FROM files WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0", FILES))
def unity_types_by_text(spark, d):
    f = A.files(spark, d)
    base = lambda n, word: F.when(F.col("doc_id") % n == 0, F.lit(f"class X : {word}\n")).otherwise("")
    s = f.select(F.col("file_path").alias("id"), F.col("file_path").alias("full_name"), F.lit("Type").alias("kind"), F.lit("Class").alias("type_name"), "file_path")
    return unity.types_by_text(s, f.withColumn("content", F.concat(base(3, "MonoBehaviour"), base(5, "ScriptableObject"), base(7, "Editor"), F.regexp_replace("content", ": ", ":")))).drop("full_name")


OBJECT = _asset("GameObject", "page_id::varchar", "'n' || length(t)")
OWNED = """owned AS (SELECT page_id, t, place, contains(t, '<b>') AS is_object, last_value(CASE WHEN contains(t, '<b>') THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS object FROM parts)"""


def _scripts(spark):
    return spark.createDataFrame([(f"g{i}", f"script{i}") for i in range(7)], "guid string, id string")


@query(with_ctes(f"SELECT DISTINCT {OBJECT.replace('length(t)', 'length(object)')} AS source_id, 'script' || length(t) % 7 AS target_id, 'Component' AS kind FROM owned WHERE NOT is_object AND object IS NOT NULL", SCENES, OWNED))
def scene_graph(spark, d):
    return unity.scene_graph(unity.documents(_scenes(spark, d)), _scripts(spark))[1]


@query(with_ctes(f"SELECT DISTINCT {OBJECT} AS id, 'n' || length(t) AS label, 'GameObject' AS kind FROM parts WHERE contains(t, '<b>') UNION ALL SELECT {_asset('Prefab', 'page_id::varchar')}, page_id::varchar, 'Prefab' FROM pages", SCENES))
def prefab_graph(spark, d):
    return unity.prefab_graph(unity.documents(_scenes(spark, d)), _scripts(spark))[0].select("id", "label", "kind")


@query(f"SELECT DISTINCT {_asset('Assembly', "'Assembly.' || event_type")} AS source_id, {_asset('Assembly', "'Lib' || user_id % 9")} AS target_id, 'AssemblyDep' AS kind FROM events")
def assembly_graph(spark, d):
    content = F.format_string('{"name": "Assembly.%s", "references": ["Lib%s"]}', "event_type", (F.col("user_id") % 9).cast("string"))
    f = table(spark, d, "events").select(F.concat(F.lit("Assets/"), F.col("event_id").cast("string"), F.lit(".asmdef")).alias("file_path"), content.alias("content"))
    return unity.assembly_graph(unity.assemblies(f))[1]


@query(f"SELECT DISTINCT {_asset('Addressable', "'Addressables'")} AS source_id, {_asset('AddressableAsset', "'Assets/' || length(html) || '.cs'")} AS target_id, 'AddressableRef' AS kind FROM pages UNION ALL SELECT DISTINCT {_asset('AddressableAsset', "'Assets/' || length(html) || '.cs'")}, 's' || length(html), 'References' FROM pages WHERE length(html) % 2 = 0")
def addressable_graph(spark, d):
    """Every page's length is the name of an asset; those of even length are scripts."""
    n = F.length("html").cast("string")
    p = table(spark, d, "pages")
    content = F.concat(F.lit("m_AssetGuid: a1\nm_AssetPath: Assets/"), n, F.lit(".cs\n"))
    scripts = p.where("length(html) % 2 = 0").select(n.alias("name"), F.concat(F.lit("s"), n).alias("id")).distinct()
    found = unity.addressables(p.select(F.concat(F.lit("G"), F.col("page_id").cast("string"), F.lit(".asset")).alias("file_path"), content.alias("content")))
    return unity.addressable_graph(found, scripts)[1]


@query(f"SELECT p_partkey AS id, {_asset('UnityEvent', 'p_name')} AS event_id FROM part WHERE p_size % 4 IN (0, 1, 2)")
def event_fields(spark, d):
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "UnityEvent<int>").when(k == 1, "UnityEngine.Events.Thing").when(k == 2, "MyAction").otherwise("int")
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("full_name"), F.lit("Field").alias("kind"), kind.alias("type_name"), F.array(F.lit("SerializeField")).alias("attributes"))
    return unity.event_fields(s).select("id", "event_id")


@query(f"SELECT DISTINCT {_asset('UnityEvent', 'a.p_name')} AS source_id, b.p_partkey AS target_id, 'UnityEvent' AS kind FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_size % 4 = 0")
def event_edges(spark, d):
    """Parts of the same name listen to an event."""
    part = table(spark, d, "part")
    fields = part.where("p_size % 4 = 0").select(F.col("p_name").alias("full_name"), ids.asset_id("UnityEvent", F.col("p_name")).alias("event_id"))
    return unity.event_edges(fields, part.select(F.col("p_name").alias("full_name"), F.col("p_partkey").alias("target_id")))


# Designs ----------------------------------------------------------------------------------------------------------------


@query(with_ctes("SELECT a.source_id AS n0, a.target_id AS n1 FROM inherits a JOIN customer x ON x.c_custkey = a.source_id JOIN customer y ON y.c_custkey = a.target_id WHERE x.c_acctbal < 0 AND y.c_mktsegment = 'MACHINERY' AND y.c_name LIKE '%1'", INHERITS))
def pattern_constraints(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), "c_acctbal", "c_name")
    return graph.match_pattern(n, A.inherits(spark, d), [None, "MACHINERY"], ["Inherits"], {0: "c_acctbal < 0", 1: "c_name like '%1'"})


STEPS = """items AS (SELECT source AS question, doc_id AS id, ['symbol', 'snippet', 'relation'][doc_id % 3 + 1] AS kind, (doc_id % 10) / 10.0::double AS score, doc_id % 4 AS distance, text AS content, length(text) // 4 AS tokens FROM documents),
s1 AS (SELECT * EXCLUDE total FROM (SELECT *, sum(tokens) OVER (PARTITION BY question) AS total FROM items) WHERE total <= 20000 OR score >= 0.5),
s2 AS (SELECT * REPLACE (CASE WHEN total > 20000 AND kind = 'snippet' THEN least(tokens, 20000 // n) ELSE tokens END AS tokens) FROM (SELECT *, sum(tokens) OVER (PARTITION BY question) AS total, greatest(count(*) FILTER (kind = 'snippet') OVER (PARTITION BY question), 1) AS n FROM s1)),
s3 AS (SELECT * EXCLUDE t FROM (SELECT *, sum(tokens) OVER (PARTITION BY question) AS t FROM s2) WHERE t <= 20000 OR kind != 'relation' OR distance <= 1)"""


@query(with_ctes("SELECT question, id, kind, tokens::bigint AS tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY question) AS t, sum(tokens) OVER (PARTITION BY question ORDER BY kind != 'symbol', score DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM s3) WHERE t <= 20000 OR upto <= 20000", STEPS))
def context_compressed(spark, d):
    """Documents as symbols, snippets and relations of a question about their source."""
    k, text_ = F.col("doc_id"), F.col("text")
    items = table(spark, d, "documents").select(
        F.col("source").alias("question"), k.alias("id"), F.element_at(F.array(F.lit("symbol"), F.lit("snippet"), F.lit("relation")), (k % 3 + 1).cast("int")).alias("kind"), ((k % 10) / F.lit(10.0)).alias("score"), (k % 4).alias("distance"),
        text_.alias("content"), F.expr("length(text) div 4").alias("tokens"),
    )
    return retrieval.compressed(items, 20_000).select("question", "id", "kind", "tokens")


@query(
    with_ctes(
        """SELECT 'graph TD' || chr(10) || (SELECT string_agg('    ' || c_custkey || '["' || c_name || '"]' || CASE WHEN c_custkey % 2 = 0 THEN ':::interface' ELSE '' END, chr(10) ORDER BY c_name) FROM customer WHERE c_custkey IN (FROM near)) || chr(10)
 || (SELECT string_agg('    ' || source_id || ' -->|inherits| ' || target_id, chr(10) ORDER BY source_id::varchar, target_id::varchar) FROM inherits WHERE source_id IN (FROM near) AND target_id IN (FROM near)) || chr(10) || '    classDef interface fill:#e1f5fe' AS mermaid""",
        INHERITS, "near AS (SELECT 7 AS k UNION SELECT 1 UNION SELECT source_id FROM inherits WHERE target_id = 7)",
    )
)
def hierarchy_diagram(spark, d):
    """A class, its base and what derives from it."""
    from symgraph.plans import export

    e, seed = A.inherits(spark, d), spark.createDataFrame([(7,)], "seed long")
    kind = F.when(F.col("c_custkey") % 2 == 0, "Interface").otherwise("Class")
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_name").alias("label"), kind.alias("kind"))
    return export.diagram(*graph.subgraph(n, e, seed, 1))
