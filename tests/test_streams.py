"""State that lasts from batch to batch, and projects that see one another."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symgraph.plans import queries_streams
from symgraph.sources import csharp
from symgraph.streaming import changes as C


def put(spark, log, rows):
    spark.createDataFrame(rows, C.LOG).coalesce(1).write.mode("append").parquet(log)


def test_watch_forgets_no_hash_over_batches_and_restarts(spark, tmp_path):
    log, at, seen = str(tmp_path / "log"), str(tmp_path / "at"), []

    def run():
        C.watch(spark, log, at, lambda df, n: seen.extend(sorted((r.file_path, r.change_type, r.hash) for r in df.collect()))).awaitTermination()
        got = seen[:]
        seen.clear()
        return got

    put(spark, log, [(1, "a", "New", "h1", None), (1, "b", "New", "h2", None), (1, "a", "Modified", "h1", None)])
    assert run() == [("a", "Modified", "h1"), ("b", "New", "h2")]
    put(spark, log, [(2, "a", "Modified", "h1", None), (2, "b", "Modified", "h3", None), (2, "gone", "Deleted", None, None)])
    assert run() == [("b", "Modified", "h3"), ("gone", "Deleted", None)]
    put(spark, log, [(3, "c", "Renamed", "h1", "a")])
    assert run() == [("a", "Deleted", "h1"), ("c", "New", "h1")]
    put(spark, log, [(4, "a", "Deleted", None, None), (4, "a", "New", "h1", None), (4, "c", "Modified", "h1", None)])
    assert run() == [("a", "New", "h1")]


def test_cache_reads_refresh(spark, tmp_path):
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "at"))
    start = dt.datetime(2024, 1, 1)
    minutes = [[("k", 0, 0), ("k", 1, 20), ("other", 2, 5)], [("k", 3, 45)], [("k", 4, 80), ("other", 5, 36), ("k", 6, 81)]]
    for rows in minutes:
        spark.createDataFrame([(k, i, start + dt.timedelta(minutes=m)) for k, i, m in rows], "key string, id long, ts timestamp").coalesce(1).write.mode("append").parquet(log)
        reads = spark.readStream.schema("key string, id long, ts timestamp").parquet(log)
        C.cache_reads(reads).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.hit for r in spark.read.parquet(out).collect()} == {0: False, 1: True, 2: False, 3: True, 4: False, 6: True}  # 5 came too late


def test_cache_hits_of_events_out_of_order_of_time(spark, tmp_path, monkeypatch):
    start, ttl = dt.datetime(2024, 1, 1), dt.timedelta(hours=6)
    rows = [(200 - k, start + dt.timedelta(hours=2 * k + k % 5), k * k % 7) for k in range(200)] + [(201, start, 9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    last, want = {}, {}
    for e, ts, u in sorted(rows, key=lambda r: (r[1], r[0])):
        want[e] = u in last and ts - last[u] <= ttl
        last[u] = ts
    assert {r.event_id: r.hit for r in queries_streams.cache_hits(spark, str(tmp_path)).collect()} == want and 20 < sum(want.values()) < 180


@pytest.mark.parametrize("buckets", [1, 2, C.BUCKETS])
def test_cache_keys_share_a_bucket(spark, tmp_path, buckets):
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "at"))
    start, kind = dt.datetime(2024, 1, 1), "key long, id long, ts timestamp"
    big = (1 << 60) + 1
    for rows in ([(big, 0, 0), (None, 1, 3), (big + 1, 2, 5), (7, 9, 5)], [(big, 3, 29), (None, 4, 33), (big + 1, 5, 36), (8, 6, 36)], [(big, 7, 59), (8, 8, 90)]):
        spark.createDataFrame([(k, i, start + dt.timedelta(minutes=m)) for k, i, m in rows], kind).coalesce(1).write.mode("append").parquet(log)
        C.cache_reads(spark.readStream.schema(kind).parquet(log), buckets=buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.key, r.hit) for r in spark.read.parquet(out).collect()}
    assert got == {0: (big, False), 1: (None, False), 2: (big + 1, False), 9: (7, False), 3: (big, True), 4: (None, True), 5: (big + 1, False), 6: (8, False), 7: (big, True), 8: (8, False)}


def test_names_of_projects_that_are_not_referenced(spark):
    texts = {"one/A": "namespace N; public class A { public void M() { } }", "two/B": "namespace N; public class A2 { public void M() { } } public class Only { public void Lone() { } }", "use/C": "namespace N; public class C { void Go(A a, A2 b) { a.M(); b.M(); x.Lone(); } }"}
    rows = csharp.extract(spark.createDataFrame([(f"{k}.cs", v) for k, v in texts.items()], "file_path string, content string")).cache()
    s = csharp.symbols_of(rows).cache()
    projects = spark.createDataFrame([("one/A.cs", "P1"), ("two/B.cs", "P2"), ("use/C.cs", "P3")], "file_path string, project string")
    name = {r.id: r.full_name.removeprefix("global::N.") for r in s.collect()}
    calls = lambda scope: {name[r.target_id] for r in csharp.resolve(rows, s, scope=scope).where("kind = 'Call'").collect()}
    assert calls(None) == {"A.M", "A2.M", "Only.Lone"}
    assert calls(csharp.visible(projects, spark.createDataFrame([("P3", "P1")], "project string, target string"))) == {"A.M"}
    assert calls(csharp.visible(projects, spark.createDataFrame([("P3", "P1"), ("P1", "P2")], "project string, target string"))) == {"A.M", "A2.M", "Only.Lone"}
    assert calls(csharp.visible(projects.where(F.col("project") != "P2"), spark.createDataFrame([("P3", "P1")], "project string, target string"))) == {"A.M", "A2.M", "Only.Lone"}
