"""Change logs, caches and metrics, as streams and as their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symgraph.sources.csharp import extract
from symgraph.sources.files import change_set

LOG = "seq long, file_path string, change_type string, hash string, old_path string"


def append_changes(old: DataFrame, new: DataFrame, log: str, seq: int) -> None:
    """ST1: compares two manifests and appends what changed to the log folder; a stream of that folder sees modified and
    deleted files too, which a stream of the files themselves does not."""
    changes = change_set(old, new).select(F.lit(seq).cast("long").alias("seq"), "file_path", "change_type", "hash", F.lit(None).cast("string").alias("old_path"))
    changes.write.mode("append").parquet(log)


def expand_renames(changes: DataFrame) -> DataFrame:
    """ST3: a rename is the old path's deletion and the new path's creation."""
    rename = F.col("change_type") == "Renamed"
    one = lambda p, k: F.struct(F.col(p).alias("file_path"), F.lit(k).alias("change_type"))
    parts = F.when(rename, F.array(one("old_path", "Deleted"), one("file_path", "New"))).otherwise(F.array(F.struct("file_path", "change_type")))
    return changes.select("seq", "hash", F.inline(parts))


def latest_changes(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """ST2: each path's last change; with known (file_path, hash), not those that leave the hash as it was."""
    w = Window.partitionBy("file_path").orderBy(F.desc("seq"), F.when(F.col("change_type") == "Deleted", 0).otherwise(1).desc())
    rows = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if known is None:
        return rows
    seen = rows.join(known.select("file_path", F.col("hash").alias("was")), "file_path", "left")
    return seen.where("change_type = 'Deleted' or was is null or was != hash").drop("was")


STATE = "hash string, gone boolean"


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last of a path's changes, if it leaves another hash than the state has; the state lasts from batch to batch."""
    rows = pd.concat(frames)
    rows = rows.assign(_last=rows["change_type"] != "Deleted").sort_values(["seq", "_last"], kind="stable")
    last = rows.iloc[-1]
    was, gone = state.get if state.exists else (None, True)
    deleted = last["change_type"] == "Deleted"
    if not state.exists or deleted != gone or not deleted and last["hash"] != was:
        yield rows.iloc[[-1]].drop(columns="_last")
    state.update((None if deleted else last["hash"], bool(deleted)))


def changed(changes: DataFrame) -> DataFrame:
    """ST2: seq, hash, file_path, change_type of a stream of changes (expand_renames()) that leave a path with another hash
    than the one it had, in this batch or any before: of a path's changes in one batch only the last counts, and one that
    changes nothing is dropped. The hash of each path is kept in the state store and survives restarts."""
    return changes.groupBy("file_path").applyInPandasWithState(_changed, "seq long, hash string, file_path string, change_type string", STATE, "append", GroupStateTimeout.NoTimeout)


#: Groups of cache keys: a call into Python takes milliseconds a group, and a group's keys are handled together.
BUCKETS = 1024
NEVER = np.iinfo(np.int64).min


def _read(ttl_ms: int):
    """Hits and misses of a bucket's cache keys in the order of their reads; each read refreshes its entry."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, since = state.get if state.exists else ([], [])
        timed_out = state.hasTimedOut
        reads = [] if timed_out else list(frames)
        held = pd.Series(keys, dtype=reads[0]["key"].dtype if reads else object)
        codes, names = pd.factorize(pd.concat([held, *(r["key"] for r in reads)], ignore_index=True), use_na_sentinel=False)
        used = np.full(len(names), NEVER)
        used[codes[: len(held)]] = since
        if reads:
            rows, codes = pd.concat(reads, ignore_index=True), codes[len(held) :]
            at, ids = rows["ts"].to_numpy("datetime64[us]").astype(np.int64), rows["id"].to_numpy()
            order = np.lexsort((ids, at, codes))
            codes, at = codes[order], at[order]
            before = np.where(np.append(True, codes[1:] != codes[:-1]), NEVER, np.append(NEVER, at[:-1]))
            before = np.maximum(before, used[codes])
            hit = np.empty(len(at), bool)
            hit[order] = (before != NEVER) & (before >= at - ttl_ms * 1000)
            np.maximum.at(used, codes, at)
            yield pd.DataFrame({"key": rows["key"], "id": ids, "ts": rows["ts"], "hit": hit})
        ends, now = used // 1000 + ttl_ms + 1, state.getCurrentWatermarkMs()
        left = ends > now
        if not left.any():
            state.remove()
            return
        state.update((names[left].tolist(), used[left].tolist()))
        state.setTimeoutTimestamp(max(int(ends[left].min()), now + 1))

    return run


def cache_reads(reads: DataFrame, ttl_ms: int = 30 * 60 * 1000, watermark: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """ST6: key, id, ts, hit of a stream of reads (key, id, ts): a read is a hit if the key was read at most ttl before, and
    refreshes the entry. Entries are state with a timer, a bucket of keys each: the watermark drops those that no read could
    still hit. Reads that come later than the watermark are dropped."""
    kind = dict(reads.dtypes)["key"]
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))  # nulls apart: pandas would make longs beside them floats
    dealt = reads.withWatermark("ts", watermark).select("key", "id", "ts", bucket.alias("bucket")).groupBy("bucket")
    return dealt.applyInPandasWithState(_read(ttl_ms), f"key {kind}, id long, ts timestamp, hit boolean", f"keys array<{kind}>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def watch(spark: SparkSession, log: str, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """ST1 to ST5, S8, ST9: streams the log and hands each batch's last changes to apply, which must bear repetition. A change
    that leaves a path's hash as it was in any batch before isn't handed on (changed())."""
    stream = changed(expand_renames(spark.readStream.schema(LOG).parquet(log)))
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def extract_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the extractor's rows for each new .cs file below a folder."""
    texts = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").schema("value string").load(path)
    return extract(texts.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content")))


def observed(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """ST8: rows, and their number as it is known once an action on them has run."""
    progress = Observation(name)
    return rows.observe(progress, F.count(F.lit(1)).alias("rows")), progress


def queued(requests: DataFrame) -> DataFrame:
    """Path, priority, seq, place of the requests that wait: each path once, by its highest priority and first request."""
    once = requests.groupBy("path").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("priority").orderBy("seq", "path")))


def debounced(events: DataFrame, gap: str = "500 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """Path, number of events and last time of each burst; works on streams and tables."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))


def cache_left(entries: DataFrame, now: Column, capacity: int = 1000, ttl: str = "30 minutes") -> DataFrame:
    """ST6: entries (key, used) left of each cache (cache) by time to live, and without the oldest quarter where the rest
    still exceeds the capacity."""
    fresh = entries.where(F.col("used") > now - F.expr(f"interval {ttl}"))
    w = Window.partitionBy("cache")
    place, n = F.row_number().over(w.orderBy("used", "key")), F.count(F.lit(1)).over(w)
    return fresh.withColumn("place", place).withColumn("n", n).where((F.col("n") <= capacity) | (F.col("place") > F.expr("n div 4"))).drop("place", "n")


def last_rows(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """W3, ST7, E8: the last rows of each group; order begins with the latest."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def recent_latency(log: DataFrame, most: int = 1000) -> DataFrame:
    """Operation, mean latency of its last entries (operation, ts, latency_ms)."""
    return last_rows(log, ["operation"], [F.desc("ts"), F.desc("latency_ms")], most).groupBy("operation").agg(F.avg("latency_ms").alias("mean"), F.count(F.lit(1)).alias("n"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Name, value: the last of each."""
    return metrics.groupBy("name").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def log_lines(logs: DataFrame) -> DataFrame:
    """Text lines of (ts, level, message)."""
    return logs.select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), "level", F.lit("] "), "message").alias("value"))
