"""WARC files and a Merkle fixity audit of two replicas.

A replica is a folder of WARC files. Its records are leaves, digests of the bytes as they lie in the file. Each node above
hashes the ranges of its children in order: runs of records, files, groups of files, regions, up to one root. Equal roots
end the audit; else only children of nodes that differ are looked at. A run ends where a record's digest says so, not after
so many records, and ranges are counted from their node's start: a record that is lost or added changes its own run alone,
and what follows is merely moved.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.session import broadcast_if, materialise, shared_path
from symgraph.session import rows as count_of

#: Neighbouring page_ids that a file holds; null ones are dealt over NULL_FILES files of their own.
IDS_IN_FILE, NULL_FILES = 4096, 64
#: Bytes from which on a file's records are dealt over several files of half as many.
MOST_BYTES = 128 << 20
#: One digest in so many ends a run, and so many records do at the latest.
RUN, LONGEST_RUN = 16, 256
BROADCAST_ROWS = 200_000
BREAK = "\r\n"
END, MAGIC = b"\r\n\r\n", b"WARC/"
LEAF = "file string, place int, offset long, length long, record_id string, sha256 string, broken boolean, run int, run_start long, run_sha256 string, file_sha256 string, file_bytes long"


def record_id(page_id: str = "page_id", url: str = "url") -> Column:
    """<urn:uuid:...> of a page."""
    name = F.md5(F.concat_ws("|", F.col(page_id).cast("string"), F.col(url)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record_text(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A WARC resource record with its end: null urls and html are empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: "), record_id(page_id, url)), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col(url), F.lit(""))),
             "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    head = F.concat(*[x for line in lines for x in ((F.lit(line) if isinstance(line, str) else line), F.lit(BREAK))])
    return F.concat(head, F.lit(BREAK), body, F.lit(BREAK + BREAK))


def pages_records(pages: DataFrame) -> DataFrame:
    """page_id, record_id, record of each page."""
    return pages.select("page_id", record_id().alias("record_id"), record_text().alias("record"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows with file, those of one file in one task: neighbouring page_ids, null ones by their hash.

    Where such rows (page_id and texts) have more than MOST_BYTES, they are dealt by their hash over several files,
    and equal rows by their place in the input, so a file grows neither with its pages' sizes nor with how often an id is
    repeated, beyond its largest record."""
    nulls = F.concat(F.lit("null-"), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(NULL_FILES)).cast("string"))
    name = F.coalesce(F.floor(F.col("page_id").cast("long") / IDS_IN_FILE).cast("string"), nulls)
    rows = rows.withColumn("file", name)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind in ("string", "binary")), F.lit(512))
    large = rows.groupBy("file").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > MOST_BYTES)
    large = materialise(large.select("file", F.expr(f"bytes div {MOST_BYTES // 2} + 1").alias("parts")), "warc-large", True)
    if count_of(large):
        place = F.xxhash64(*[F.col(c) for c in rows.columns], F.monotonically_increasing_id())
        rows = rows.withColumn("place", place).join(broadcast_if(large, BROADCAST_ROWS), "file", "left").withColumn("file", F.when(F.col("parts").isNull(), F.col("file")).otherwise(F.concat_ws("-", "file", F.pmod("place", "parts").cast("string")))).drop("parts", "place")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def write_warc(rows: DataFrame, path: str, *folders: str) -> None:
    """Writes rows (file, page_id, record_id, record, and folders) that dealt() dealt as compressed WARC files path/folder=.../
    file=name/part, in the order of page_id and record_id, on any file system that Spark writes.

    record is text or binary and is written byte by byte; a null record isn't written. It ends with two line breaks, which
    are given to the text writer as its separator.
    """
    bare = F.expr("cast(substring(cast(record as binary), 1, octet_length(record) - 4) as string)")
    some = rows.where("record is not null").sortWithinPartitions(*folders, "file", "page_id", "record_id")
    some.select(*folders, "file", bare.alias("value")).write.partitionBy(*folders, "file").option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of a gzip file, whatever its members; what a broken one still gives. Other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(data), 1 << 20):
                out.append(member.decompress(data[at : at + (1 << 20)]))
                if member.eof:
                    data = member.unused_data + data[at + (1 << 20) :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out)


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-cased name; of repeated ones the first."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split(BREAK)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def records_of(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int, int, bool]]:
    """start, end, headers, payload's start and end, broken of each record.

    A record is broken if it has no head or no length, or if what its length says doesn't end with two line breaks. It then
    reaches to the next place where a record begins.
    """
    at, n = 0, len(data)
    while at < n:
        stop, fields, end = data.find(END, at), {}, -1
        if data.startswith(MAGIC, at) and stop >= 0:
            fields = headers(data[at:stop])
            if (size := fields.get("content-length", "")).isascii() and size.isdigit():
                end = stop + 4 + int(size)
        if end >= 0 and data.startswith(END, end):
            yield at, end + 4, fields, stop + 4, end, False
            at = end + 4
        else:
            after = data.find(END + MAGIC, at)
            after = n if after < 0 else after + 4
            yield at, after, fields, min(stop + 4 if stop >= 0 else after, after), after, True
            at = after


def _files(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):  # a replica without any record
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, record_id, target, record, payload (both binary), broken of each record of a folder's files.

    Offsets are those in the unpacked file. A file is read by one task and is held whole, twice if it is packed: keep files
    to some hundred MB, as is usual and as dealt() does; Spark gives no file, and so no record, of over 2 GB. An empty file
    has no record.
    """
    schema = "path string, offset long, length long, record_id string, target string, record binary, payload binary, broken boolean"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.large_binary(), pa.large_binary(), pa.bool_())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k).cast(pa.binary() if k == pa.large_binary() else k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, out, held = unpacked(content.as_py()), [], 0
                for a, b, head, body, end, broken in records_of(data):
                    out.append((name.as_py(), a, b - a, head.get("warc-record-id"), head.get("warc-target-uri"), data[a:b], data[body:end], broken))
                    held += b - a
                    if held > 1 << 23:
                        yield given(out)
                        out, held = [], 0
                if out:
                    yield given(out)

    return _files(spark, path).mapInArrow(run, schema)


def file_leaves(name: str, data: bytes) -> list[tuple]:
    """A row of LEAF for each record of a file; a run's hash is on its first row, the file's on the first of all.

    A run's hash is of its records' ranges, counted from its start, and digests; a file's of its runs' ranges and hashes.
    """
    rows, first, at = [], 0, []

    def close():
        text = ";".join(f"{r[2] - rows[first][2]}:{r[3]}:{r[5]}" for r in rows[first:])
        at.append((first, rows[first][2], rows[-1][2] + rows[-1][3], hashlib.sha256(text.encode()).hexdigest()))

    view = memoryview(data)
    for a, b, head, _, _, broken in records_of(data):
        digest = hashlib.sha256(view[a:b])
        rows.append([name, len(rows), a, b - a, head.get("warc-record-id"), digest.hexdigest(), broken, len(at), None, None, None, None])
        if digest.digest()[0] % RUN == 0 or len(rows) - first >= LONGEST_RUN:
            close()
            first = len(rows)
    if first < len(rows):
        close()
    for i, start, _, h in at:
        rows[i][8:10] = start, h
    if rows:
        rows[0][10:12] = hashlib.sha256(";".join(f"{s}:{e}:{h}" for _, s, e, h in at).encode()).hexdigest(), len(data)
    return rows


def leaves(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """LEAF of the WARC files of a replica. A file's name is what the pattern name's group finds in its path: two replicas'
    files are held against one another by name, which must be unique in a replica."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split(" ")[0] for c in LEAF.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = file_leaves(file.as_py(), unpacked(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return _files(spark, path).select(F.regexp_extract("path", name, 1).alias("file"), "content").mapInArrow(run, LEAF)


def tree(files: DataFrame) -> list[DataFrame]:
    """Levels of nodes, from files (replica, file, bytes, hash) to the root, with the columns that name a node. A node's hash
    is of its children's names, lengths and hashes in order; the lengths make their ranges."""
    below = files.withColumns({"group": F.substring(F.md5("file"), 1, 4), "region": F.substring(F.md5("file"), 1, 2)})
    levels, at = [below], "file"
    for key in (["region", "group"], ["region"], []):
        children = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "bytes", "hash")))
        text = F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c["at"], c["bytes"].cast("string"), c["hash"])))
        below = materialise(below.groupBy("replica", *key).agg(F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes")), "merkle-nodes")
        levels.append(below)
        at = key[-1] if key else ""
    return levels


def differing(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the nodes that the replicas don't both have with one hash."""
    return nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")).where("n < 2 or low != high").select(*key)


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file, place, offset, length, record_id, sha256, broken and status of each record; first and second are leaves().

    Status: ok; corrupt (the second replica has other bytes under this id); moved (the same bytes at another offset of the
    same file); missing (only the first has it in this file); extra (only the second has). Columns are the first replica's
    but for extra. Records of runs that differ are paired by record_id, repeated ones in their order; one whose id can't be
    read goes by its digest, so a damaged id is a missing record and an extra one. Broken records, as a file cut short
    ends with, are compared like others. Files that only one replica has are missing or extra record by record; empty
    replicas are equal.
    """
    both = materialise(first.withColumn("replica", F.lit("1")).unionByName(second.withColumn("replica", F.lit("2"))), "merkle-leaves")
    levels = tree(materialise(both.where("file_sha256 is not null").select("replica", "file", F.col("file_bytes").alias("bytes"), F.col("file_sha256").alias("hash")), "merkle-files"))
    columns = ["file", "place", "offset", "length", "record_id", "sha256", "broken"]
    one = both.where("replica = '1'").select(*columns)
    suspects = differing(levels[-1], [])
    if suspects.isEmpty():
        return one.withColumn("status", F.lit("ok"))
    suspects = None
    for nodes, key in zip(levels[-2::-1], (["region"], ["region", "group"], ["region", "group", "file"]), strict=True):
        if suspects is not None:
            nodes = nodes.join(broadcast_if(suspects, BROADCAST_ROWS), suspects.columns, "left_semi")
        suspects = materialise(differing(nodes, key), "merkle-suspects")
    bad = materialise(both.join(broadcast_if(suspects.select("file"), BROADCAST_ROWS), "file", "left_semi"), "merkle-bad-files")
    # runs of these files that both have, the n-th of equal ones with the n-th; they may have moved
    runs = bad.where("run_sha256 is not null").select("replica", "file", "run", "run_start", "run_sha256")
    runs = runs.withColumn("nth", F.row_number().over(Window.partitionBy("replica", "file", "run_sha256").orderBy("run_start")))
    a, b = (runs.where(F.col("replica") == r).select("file", "run_sha256", "nth", F.col("run").alias(f"run_{r}"), F.col("run_start").alias(f"start_{r}")) for r in "12")
    alike = materialise(a.join(b, ["file", "run_sha256", "nth"]).select("file", "run_1", "run_2", (F.col("start_1") != F.col("start_2")).alias("moved")), "merkle-alike")
    known = [alike.select(F.lit(r).alias("replica"), "file", F.col(f"run_{r}").alias("run"), "moved") for r in "12"]
    rest = bad.join(known[0].unionByName(known[1]), ["replica", "file", "run"], "left")
    moved = rest.where("moved and replica = '1'").select("file", "place", F.lit("moved").alias("status"))
    apart = rest.where("moved is null").withColumn("id", F.coalesce("record_id", "sha256"))
    apart = apart.withColumn("nth", F.row_number().over(Window.partitionBy("replica", "file", "id").orderBy("place")))
    c, d = (apart.where(F.col("replica") == r).select("file", "id", "nth", *[F.col(x).alias(f"{x}_{r}") for x in columns[1:]]) for r in "12")
    status = F.expr("case when sha256_2 is null then 'missing' when sha256_1 is null then 'extra' when sha256_1 != sha256_2 then 'corrupt' when offset_1 != offset_2 then 'moved' else 'ok' end")
    judged = materialise(c.join(d, ["file", "id", "nth"], "full_outer").withColumn("status", status).where("status != 'ok'"), "merkle-judged")
    marks = materialise(moved.unionByName(judged.where("status != 'extra'").select("file", F.col("place_1").alias("place"), "status")), "merkle-marks")
    marked = one.join(broadcast_if(marks, BROADCAST_ROWS), ["file", "place"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    extra = judged.where("status = 'extra'").select("file", *[F.col(f"{x}_2").alias(x) for x in columns[1:]], "status")
    return marked.select(*columns, "status").unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """page_id, url, html of a second replica for audits without one. By the first two digits of the page_id's MD5: 00 lose
    their last character and gain a tilde, 01 gain one, 02 are lost, and after 03 a record is added."""
    mark, html = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2), F.coalesce(F.col("html"), F.lit(""))
    worn = F.when(mark == "00", F.concat(F.expr("substring(coalesce(html, ''), 1, greatest(length(coalesce(html, '')) - 1, 0))"), F.lit("~"))).when(mark == "01", F.concat(html, F.lit("~"))).otherwise(html)
    own = F.struct("url", worn.alias("html"))
    added = F.struct(F.concat(F.coalesce("url", F.lit("")), F.lit("#added")).alias("url"), F.lit("added").alias("html"))
    rows = F.when(mark == "02", F.array().cast("array<struct<url:string,html:string>>")).when(mark == "03", F.array(own, added)).otherwise(F.array(own))
    return pages.select("page_id", *[c for c in ("file",) if c in pages.columns], F.inline(rows))


def audit_of_damage(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages written as two replicas of WARC files into the shared folder, the second one damaged(), and their audit."""
    path = shared_path(spark, "warc")
    rows = dealt(pages.select("page_id", "url", "html"))
    both = rows.withColumn("replica", F.lit("first")).unionByName(damaged(rows).withColumn("replica", F.lit("second")))
    write_warc(both.select("replica", "file", "page_id", record_id().alias("record_id"), record_text().alias("record")), path, "replica")
    return audit(*(leaves(spark, f"{path}/replica={r}", r"/file=([^/]+)/[^/]+$") for r in ("first", "second")))


#: For DuckDB: the records of both replicas, paired by their ids.
ORACLE = r"""
WITH marks AS (SELECT page_id, url, coalesce(html, '') AS html, substr(md5(page_id::varchar), 1, 2) AS mark FROM pages),
bodies AS (SELECT 1 AS replica, page_id, url, html FROM marks
 UNION ALL SELECT 2, page_id, url, CASE mark WHEN '00' THEN substr(html, 1, greatest(length(html) - 1, 0)) || '~' WHEN '01' THEN html || '~' ELSE html END FROM marks WHERE mark != '02'
 UNION ALL SELECT 2, page_id, coalesce(url, '') || '#added', 'added' FROM marks WHERE mark = '03'),
ids AS (SELECT *, '<urn:uuid:' || regexp_replace(md5(concat_ws('|', page_id::varchar, url)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' AS record_id FROM bodies),
records AS (SELECT replica, page_id, record_id, 'WARC/1.0' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: ' || record_id || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'WARC-Date: 2000-01-01T00:00:00Z' || n
 || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(html)::varchar || n || n || html || n || n AS record FROM ids, (SELECT chr(13) || chr(10) AS n)),
placed AS (SELECT replica, (page_id // 4096)::varchar AS file, record_id, strlen(record) AS length, sha256(record) AS sha256, row_number() OVER w - 1 AS place, sum(strlen(record)) OVER w - strlen(record) AS start
 FROM records WINDOW w AS (PARTITION BY replica, page_id // 4096 ORDER BY page_id, record_id ROWS UNBOUNDED PRECEDING))
SELECT coalesce(a.file, b.file) AS file, coalesce(a.place, b.place)::int AS place, coalesce(a.start, b.start)::bigint AS "offset", coalesce(a.length, b.length)::bigint AS length, record_id, coalesce(a.sha256, b.sha256) AS sha256, false AS broken,
 CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' WHEN a.sha256 != b.sha256 THEN 'corrupt' WHEN a.start != b.start THEN 'moved' ELSE 'ok' END AS status
FROM (FROM placed WHERE replica = 1) a FULL JOIN (FROM placed WHERE replica = 2) b USING (file, record_id)
"""
