"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.session import in_batches  # noqa: F401 (for the operators here)

WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, str]]:
    """Index and text of each row; converts one value at a time, so that one long text is in memory once."""
    for i, x in enumerate(batch.column(batch.schema.get_field_index(column))):
        yield i, x.as_py() or ""


#: Rows that a worker turns into results at a time.
AT_ONCE = 512


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable:
    """A mapInArrow function: make() runs once in each task and gives the function for its batches, AT_ONCE rows each."""

    def run(batches):
        each = make()
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                yield each(b.slice(at, AT_ONCE))

    return run


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def spread(docs: DataFrame) -> DataFrame:
    """docs, which a file scan gives, over all cores: dealt anew if the scan has fewer partitions, which few or small files
    do. Larger inputs are left as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
