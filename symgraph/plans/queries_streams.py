"""Queries with state: streams of several batches, stopped and started again in between, and places within spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.operators import intervals, retrieval
from symgraph.registry import query
from symgraph.session import shared_path, table
from symgraph.streaming import changes as C

CHUNKS = 4


def _batches(rows, path: str, run) -> None:
    """Appends the chunks of rows (chunk) one after another to the folder, each by all tasks, and runs the stream to its end
    after each: all that is new is one batch, then the stream is stopped and begins again from its checkpoint."""
    for k in range(CHUNKS):
        rows.where(F.col("chunk") == k).drop("chunk").write.mode("append").parquet(path)
        run().awaitTermination()


def _chunked(spark, d):
    e = table(spark, d, "events")
    n = e.count()
    return e.withColumn("chunk", F.least(F.floor(F.col("event_id") * CHUNKS / F.lit(max(1, n))), F.lit(CHUNKS - 1)).cast("int"))


@query(
    f"""WITH c AS (SELECT *, least(event_id * {CHUNKS} // (SELECT count(*) FROM events), {CHUNKS - 1}) AS chunk FROM events),
last AS (SELECT user_id, chunk, arg_max(event_type, event_id) AS hash, max(event_id) AS seq FROM c GROUP BY user_id, chunk),
seen AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY chunk) AS was FROM last)
SELECT 'user' || user_id AS file_path, seq, CASE WHEN hash = 'error' THEN 'Deleted' ELSE 'Modified' END AS change_type FROM seen WHERE was IS NULL OR was != hash"""
)
def watcher_state(spark, d):
    """Events as changes of their user's file, in four batches with restarts: one that leaves the file as an earlier batch
    left it isn't reported."""
    log, out, at = (shared_path(spark, n) for n in ("state-log", "state-out", "state-checkpoint"))
    e = _chunked(spark, d)
    gone = F.col("event_type") == "error"
    rows = e.select("chunk", F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("user"), "user_id").alias("file_path"), F.when(gone, "Deleted").otherwise("Modified").alias("change_type"), F.when(~gone, F.col("event_type")).alias("hash"), F.lit(None).cast("string").alias("old_path"))

    def run():
        stream = C.changed(C.expand_renames(spark.readStream.schema(C.LOG).parquet(log)))
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()

    _batches(rows, log, run)
    return spark.read.parquet(out).select("file_path", "seq", "change_type")


def _by_time(spark, d):
    """Events in chunks of about equal size that follow one another in time, whatever the order of their ids: a read that
    comes later than the watermark would be dropped."""
    e = table(spark, d, "events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = e.select(F.percentile_approx("_at", [k / CHUNKS for k in range(1, CHUNKS)], 1000)).first()[0] or []
    return e.withColumn("chunk", F.coalesce(sum(((F.col("_at") > c).cast("int") for c in cuts), F.lit(0)), F.lit(CHUNKS - 1))).drop("_at")


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000, false) AS hit FROM events")
def cache_hits(spark, d):
    """Events as reads of their user's cache entry, which lives for six hours after its last read."""
    log, out, at = (shared_path(spark, n) for n in ("cache-log", "cache-out", "cache-checkpoint"))
    rows = _by_time(spark, d).select("chunk", F.col("user_id").alias("key"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))

    def run():
        reads = spark.readStream.schema(rows.drop("chunk").schema).parquet(log)
        return C.cache_reads(reads, 6 * 3600 * 1000).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()

    _batches(rows, log, run)
    return spark.read.parquet(out).select(F.col("id").alias("event_id"), "hit")


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, line FROM lines WHERE contains(lower(t), 'the')),
sizes(size) AS (VALUES (3), (7), (40), (1000000)), spans AS (SELECT doc_id, size, k * size + 1 + (size = 7)::int AS a, least(n, (k + 1) * size) AS b FROM (SELECT DISTINCT doc_id, n FROM lines), sizes, range(0, 100000) r(k) WHERE k * size < n AND size + k % 2 != 3)
SELECT p.doc_id, p.line, arg_min(size || ':' || a, (b - a, -a, size || ':' || a)) AS span FROM places p JOIN spans s ON s.doc_id = p.doc_id AND p.line BETWEEN a AND b GROUP BY ALL"""
)
def enclosing_spans(spark, d):
    """Each line with a word, and the smallest of nested and overlapping spans of its document's lines that holds it."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file_path"), F.split("text", "\n", -1).alias("lines"))
    places = docs.select("file_path", F.posexplode("lines").alias("line", "t")).where(F.contains(F.lower("t"), F.lit("the"))).select("file_path", (F.col("line") + 1).alias("line"))
    sized = docs.select("file_path", F.size("lines").alias("n"), F.explode(F.array(*map(F.lit, (3, 7, 40, 1_000_000)))).alias("size"))
    spans = sized.withColumn("k", F.explode(F.expr("sequence(0, (n - 1) div size)"))).where("size + k % 2 != 3")
    spans = spans.select("file_path", F.expr("k * size + 1 + if(size = 7, 1, 0)").alias("start"), F.expr("least(n, (k + 1) * size)").alias("end"), "size")
    spans = spans.withColumn("id", F.concat_ws(":", "size", "start"))
    return intervals.enclosing(spans, places).select(F.col("file_path").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("id").alias("span"))


@query(
    """WITH w AS (SELECT vec_id AS id, event_type AS model, ts AS since, event_id AS seq FROM events JOIN embeddings ON vec_id = user_id),
last AS (SELECT id, model, since, max(seq) AS seq FROM w GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY since) AS version FROM last),
asked AS (SELECT event_id, user_id AS id, 'view' AS model, ts - INTERVAL 3 HOUR AS time FROM events UNION ALL SELECT event_id, user_id, 'error', ts FROM events)
SELECT a.event_id, a.id, a.model, version::int AS version, seq FROM asked a ASOF LEFT JOIN v ON a.id = v.id AND a.model = v.model AND a.time >= v.since"""
)
def embedding_as_of(spark, d):
    """Events as new embeddings of a vector by a model, and which one was valid at each event, and before."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("id"), "event_type", "ts")
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"))
    held = retrieval.versions(e.join(v, "id").select("id", F.col("event_type").alias("model"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))
    asked = e.select("event_id", "id", F.lit("view").alias("model"), (F.col("ts") - F.expr("interval 3 hours")).alias("time")).unionByName(e.select("event_id", "id", F.lit("error").alias("model"), F.col("ts").alias("time")))
    return retrieval.as_of(held, asked).select("event_id", "id", "model", "version", "seq")


@query(
    r"""WITH cut AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[\s.,;:?!()''"]+'), lambda w: w != '') AS w FROM conversations WHERE role = 'user'),
heads AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s.,;:?!()''"]+'), lambda w: w != '') AS w FROM documents),
names AS (SELECT array_to_string(w[:n], ' ') AS name, min(doc_id) AS id FROM heads, range(1, 4) r(n) WHERE len(w) >= n GROUP BY 1),
runs AS (SELECT conv_id, turn, p AS place, n AS words, array_to_string(w[p:p + n - 1], ' ') AS name FROM cut, range(1, 5) r(n), unnest(range(1, len(w) + 1)) t(p) WHERE p + n - 1 <= len(w)),
hits AS (SELECT r.*, id FROM runs r JOIN names USING (name))
SELECT conv_id, turn, place::int AS place, words::int AS words, name, id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.conv_id = h.conv_id AND o.turn = h.turn AND o.words > h.words AND o.place <= h.place AND o.place + o.words >= h.place + h.words)"""
)
def question_entities(spark, d):
    """What user turns name of the documents' beginnings: their first one to three words."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    heads = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), r"[\s.,;:?!()'\"]+"), lambda w: w != "").alias("w"))
    names = heads.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("size(w) >= n").groupBy(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name")).agg(F.min("doc_id").alias("id"))
    return retrieval.entities(asked, names).select("conv_id", "turn", "place", "words", "name", "id")
