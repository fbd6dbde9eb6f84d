"""Token ids in ORC.

Integers are run-length encoded in stripes; each stripe has a row index and a Bloom filter on doc_id, so readers split
files by stripe and skip those that a predicate on doc_id rules out. Files are in ascending doc_id order. Besides a
document's ids a row has the document's place within its part, so that places in the whole corpus need the parts' totals
only.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.llm.common import AT_ONCE, in_batches, per_batch, rows_of, text_of
from symgraph.llm.pieces import REMEMBERED, Pieces
from symgraph.session import shared_path

ORC = {"compression": "snappy", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20)}


@lru_cache(1)
def byte_names() -> dict[int, str]:
    """Byte-level BPE's name of each byte: printable ones name themselves, the others take characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(other)) for b in range(256)}


class LibraryEncoder(Pieces):
    """Pieces encoded by the tokenizers library's model, each when it is first seen.

    The library splits a text by the same pattern and names its bytes before it asks the model, so a text's ids are
    those of its pieces.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__(pattern, 2 * REMEMBERED)
        self.library, self.names = Tokenizer.from_file(path), byte_names()
        self.model = self.library.model

    def made(self, piece: str) -> bytes:
        named = f"{self.names[32]}{piece[1:]}" if piece[0] == " " and piece.isascii() and piece[1:].isalnum() else piece.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special token, which the library looks for before it splits
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return super().encode(text)


@lru_cache(2)
def loaded(path: str, pattern: str) -> LibraryEncoder:
    """A worker's encoder, kept from task to task."""
    return LibraryEncoder(path, pattern)


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end: int, parts: int | None = None) -> None:
    """Encodes each row's text, appends the end id, and writes ORC files in ascending doc_id order.

    Texts are dealt by ranges of doc_id and of how they begin, so many rows of one id, or without one, are dealt to several
    parts, and encoded once, on the far side, AT_ONCE rows at a time. Null texts are empty (the end id alone); a null
    doc_id comes first; rows of equal doc_id are ordered by text; an empty table writes files without rows. A long text is
    encoded whole by one worker and is one row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    tail = struct.pack("<I", end)

    def run(batches):
        encoder, place = loaded(tokenizer, pattern), 0
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch, ids, places = whole.slice(at, AT_ONCE), [], []
                for _, text in rows_of(batch, "text"):
                    ids.append(np.frombuffer(encoder.encode(text) + tail, "<i4"))
                    places.append(place)
                    place += len(ids[-1])
                sizes = np.array([len(x) for x in ids], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.int64()), pa.array(sizes), lists], names=["doc_id", "part", "place", "n_tokens", "ids"])

    in_batches(rows).mapInArrow(run, "doc_id long, part int, place long, n_tokens int, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place, n_tokens, ids of the files; predicates on doc_id prune stripes and row groups."""
    return spark.read.schema("doc_id long, part int, place long, n_tokens int, ids array<int>").orc(path)


def starts(rows: DataFrame) -> DataFrame:
    """part and the number of ids in the parts before it: one row for each part that has rows."""
    ends = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return ends.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files."""
    rows = read(spark, path)
    slim = rows.select("doc_id", "part", "place", "ids")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(3)
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

        return each

    found = in_batches(slim).mapInArrow(per_batch(make), "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    joined = found.join(F.broadcast(starts(rows)), "part")  # a row a part, and the writer sets the number of parts
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2) -> DataFrame:
    """Writes docs into the shared folder and gives checksums() of what was written."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write(docs, path, tokenizer, pattern, end)
    return checksums(spark, path)
