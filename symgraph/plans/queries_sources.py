"""Queries over files, changes, metrics, Unity-like text, exports and the C# extractor."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.plans import adapters as A
from symgraph.plans import export
from symgraph.plans.adapters import CALLS, DECLARES, FILES, MANIFESTS, NODES, SYMBOLS, with_ctes
from symgraph.registry import query
from symgraph.session import shared_path, table
from symgraph.sources import unity
from symgraph.sources import files as S
from symgraph.streaming import changes as C

CHANGES = MANIFESTS + """,
changes AS (SELECT * FROM (SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'New' WHEN n.file_path IS NULL THEN 'Deleted' WHEN o.hash != n.hash THEN 'Modified' END AS change_type, n.hash FROM old_m o FULL JOIN new_m n ON o.file_path = n.file_path) WHERE change_type IS NOT NULL)"""


@query(with_ctes("SELECT file_path, change_type, hash FROM changes", FILES, CHANGES))
def change_set(spark, d):
    return S.change_set(*A.manifests(spark, d))


@query(with_ctes("SELECT count(*) FILTER (change_type = 'New') AS new, count(*) FILTER (change_type = 'Modified') AS modified, count(*) FILTER (change_type = 'Deleted') AS deleted, count(*) AS total, count(*) > 0 AS has_changes FROM changes", FILES, CHANGES))
def change_totals(spark, d):
    return S.change_totals(S.change_set(*A.manifests(spark, d)))


@query(with_ctes("SELECT file_path, hash FROM new_m", FILES, CHANGES))
def incremental_apply(spark, d):
    old, new = A.manifests(spark, d)
    return S.apply_changes(old, S.change_set(old, new), new).select("file_path", "hash")


@query(with_ctes("SELECT coalesce(o.file_path, n.file_path) AS id, CASE WHEN o.file_path IS NULL THEN 'Added' WHEN n.file_path IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM old_m o FULL JOIN new_m n ON o.file_path = n.file_path WHERE o.hash IS DISTINCT FROM n.hash", FILES, CHANGES))
def symbol_diff(spark, d):
    old, new = (m.select(F.col("file_path").alias("id"), F.col("hash").alias("code_hash")) for m in A.manifests(spark, d))
    return S.symbol_diff(old, new)


@query("SELECT event_id AS seq, 'u' || user_id || CASE WHEN k = 0 THEN '.old' ELSE '' END AS file_path, CASE WHEN k = 0 THEN 'Deleted' ELSE 'New' END AS change_type FROM events, (VALUES (0), (1)) t(k) WHERE event_type = 'view' UNION ALL SELECT event_id, 'u' || user_id, 'Modified' FROM events WHERE event_type != 'view'")
def rename_expand(spark, d):
    e = table(spark, d, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "view", "Renamed").otherwise("Modified")
    log = e.select(F.col("event_id").alias("seq"), path.alias("file_path"), kind.alias("change_type"), F.lit("h").alias("hash"), F.concat(path, F.lit(".old")).alias("old_path"))
    return C.expand_renames(log).select("seq", "file_path", "change_type")


@query("SELECT 'u' || user_id AS file_path, max(event_id) AS seq, arg_max(event_type, event_id) AS hash FROM events GROUP BY 1")
def watcher_latest(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.lit("Modified").alias("change_type"), F.col("event_type").alias("hash"))
    return C.latest_changes(log).select("file_path", "seq", "hash")


@query("SELECT event_type AS cache, event_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY) WHERE n <= 1000 OR p > n // 4")
def cache_evict(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("used"))
    return C.cache_left(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), 1000, "20 days").select("cache", "key")


@query("SELECT event_type AS operation, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events) WHERE k <= 1000 GROUP BY 1")
def metrics_last1000(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("operation"), "ts", F.col("value").alias("latency_ms"))
    return C.recent_latency(log).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS name, arg_max(value, ts) AS value FROM events GROUP BY 1")
def metrics_latest(spark, d):
    return C.latest_metrics(table(spark, d, "events").select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq")))


@query("SELECT 'symgraph_' || event_type || '_last ' || format('{:.2f}', arg_max(value, ts)) AS line FROM events GROUP BY event_type")
def metrics_prometheus(spark, d):
    rows = C.latest_metrics(table(spark, d, "events").select(F.concat("event_type", F.lit(".last")).alias("name"), "value", "ts", F.col("event_id").alias("seq")))
    return export.prometheus(rows)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 10")
def recent_logs(spark, d):
    return C.last_rows(table(spark, d, "events"), ["event_type"], [F.desc("ts"), "event_id"], 10).select("event_id")


@query("SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || event_type || '] user ' || user_id AS value FROM events")
def log_lines(spark, d):
    e = table(spark, d, "events")
    return C.log_lines(e.select("ts", F.col("event_type").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message")))


@query("SELECT 'u' || user_id AS path, count(*) AS events, max(ts) AS last FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g")
def debounce(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts")
    return C.debounced(e, "2 hours").select("path", "events", "last")


@query("SELECT 'u' || user_id AS path, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS priority, min(event_id) AS seq FROM events GROUP BY 1")
def index_queue(spark, d):
    e = table(spark, d, "events")
    priority = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return C.queued(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), priority.alias("priority"), F.col("event_id").alias("seq"))).drop("place")


@query("SELECT event_id, (props->>'$.k')::bigint AS k FROM events")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT 'Assembly.' || event_type AS name, event_id::varchar AS to, substr(sha256('Assembly:' || 'Assembly.' || event_type), 1, 32) AS source_id FROM events")
def asmdef_parse(spark, d):
    e = table(spark, d, "events")
    text = F.format_string('{"name": "Assembly.%s", "references": ["%s"], "other": %s}', "event_type", F.col("event_id").cast("string"), "props")
    found = unity.assemblies(e.select(F.concat(F.lit("Assets/"), F.col("event_id").cast("string"), F.lit(".asmdef")).alias("file_path"), text.alias("content")))
    return found.select("name", F.explode("references").alias("to"), unity.ids.asset_id("Assembly", F.col("name")).alias("source_id"))


SCENES = """parts AS (SELECT page_id, unnest(string_split(html, '<p>')) AS t, generate_subscripts(string_split(html, '<p>'), 1) AS place FROM pages)"""


def _scenes(spark, d):
    """Pages as scenes: each paragraph that holds a <b> begins a GameObject, the others are components."""
    parts = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_path"), F.posexplode(F.split("html", "<p>", -1)).alias("place", "t"))
    head = F.when(F.contains("t", F.lit("<b>")), F.concat(F.lit("!u!1 &"), F.col("place").cast("string"), F.lit("\nGameObject:\n  m_Name: n"), F.length("t").cast("string"))).otherwise(F.concat(F.lit("!u!114 &"), F.col("place").cast("string"), F.lit("\nMonoBehaviour:\n  m_Script: {fileID: 1, guid: g"), (F.length("t") % 7).cast("string"), F.lit("}")))
    return parts.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", head.alias("h")))), lambda x: F.concat(F.lit("--- "), x["h"])), "\n").alias("content"))


@query(with_ctes("SELECT page_id::varchar AS file_path, (place - 1)::varchar AS file_id, CASE WHEN contains(t, '<b>') THEN 1 ELSE 114 END AS class_id, CASE WHEN contains(t, '<b>') THEN 'n' || length(t) END AS name, CASE WHEN NOT contains(t, '<b>') THEN 'g' || length(t) % 7 END AS script_guid FROM parts", SCENES))
def scene_parse(spark, d):
    return unity.documents(_scenes(spark, d)).select("file_path", "file_id", "class_id", "name", "script_guid")


@query(with_ctes("SELECT page_id::varchar AS file_path, (place - 1)::varchar AS file_id, last_value(CASE WHEN contains(t, '<b>') THEN (place - 1)::varchar END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS owner FROM parts", SCENES))
def carry_forward(spark, d):
    return unity.documents(_scenes(spark, d)).select("file_path", "file_id", "owner")


@query(with_ctes("SELECT page_id::varchar AS file_path, count(*) FILTER (contains(t, '<b>')) AS objects, count(*) FILTER (NOT contains(t, '<b>')) AS components FROM parts GROUP BY 1", SCENES))
def scene_components(spark, d):
    return unity.component_totals(unity.documents(_scenes(spark, d)))


@query("SELECT 'G' || page_id || '.asset' AS file_path, 'G' || page_id AS address, unnest(['a' || page_id, 'b' || page_id]) AS guid, unnest(['Assets/' || length(html) || '.cs', '']) AS asset FROM pages")
def addressable_zip(spark, d):
    p = F.col("page_id").cast("string")
    text = F.concat(F.lit("m_AssetGuid: a"), p, F.lit('\nm_AssetPath: "Assets/'), F.length("html").cast("string"), F.lit('.cs"\nm_AssetGuid: b'), p, F.lit("\n"))
    return unity.addressables(table(spark, d, "pages").select(F.concat(F.lit("G"), p, F.lit(".asset")).alias("file_path"), text.alias("content")))


@query(
    with_ctes(
        "SELECT d.source_id, d.target_id, coalesce(a.label, 'External(Declares)') AS source_label, coalesce(b.label, 'External(Declares)') AS target_label, d.kind, '#8b949e' AS color FROM declares d LEFT JOIN (SELECT * FROM nodes WHERE label != 'NATION_3') a ON a.id = source_id LEFT JOIN nodes b ON b.id = target_id",
        SYMBOLS, NODES, DECLARES,
    )
)
def graph_export(spark, d):
    n = A.nodes(spark, d)
    return export.graph_edges(n.where("label != 'NATION_3'"), A.declares(spark, d))


@query(with_ctes("SELECT id, label, kind, CASE kind WHEN 'Class' THEN '#58a6ff' WHEN 'Method' THEN '#3fb950' ELSE '#d29922' END AS color, CASE kind WHEN 'Class' THEN 10 ELSE 5 END AS size FROM nodes", SYMBOLS, NODES))
def graph_export_nodes(spark, d):
    return export.graph_nodes(A.nodes(spark, d))


@query(
    with_ctes(
        """SELECT 'graph TD' || chr(10) || (SELECT string_agg('    ' || substr(id, 1, 8) || '["' || label || '"]', chr(10) ORDER BY k, full_name, id) FROM (SELECT *, CASE kind WHEN 'Class' THEN 1 ELSE 3 END AS k FROM nodes WHERE kind IN ('Class', 'Method') ORDER BY k, full_name, id LIMIT 50)) || chr(10) ||
(SELECT string_agg('    ' || substr(source_id, 1, 8) || ' --> ' || substr(target_id, 1, 8), chr(10) ORDER BY source_id, target_id) FROM (SELECT * FROM declares ORDER BY source_id, target_id LIMIT 100)) AS mermaid""",
        SYMBOLS, NODES, DECLARES,
    )
)
def mermaid_export(spark, d):
    return export.mermaid(A.nodes(spark, d), A.declares(spark, d), edge_kinds=("Inherits", "Declares"))


@query(with_ctes("SELECT DISTINCT source_id AS s, target_id AS t FROM calls", CALLS))
def graph_store_round_trip(spark, d):
    path = shared_path(spark, "graph")
    S.save(A.calls(spark, d), path, "kind")
    return S.load(spark, path).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))


@query(with_ctes("SELECT file_path, change_type, hash FROM changes", FILES, CHANGES))
def stream_changes(spark, d):
    """The change log of two manifests, streamed; the result is what the stream applied."""
    log, out = shared_path(spark, "change-log"), shared_path(spark, "applied")
    old, new = A.manifests(spark, d)
    C.append_changes(old, new, log, 1)
    stream = C.watch(spark, log, shared_path(spark, "stream"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    stream.awaitTermination()
    return spark.read.parquet(out).select("file_path", "change_type", "hash")
