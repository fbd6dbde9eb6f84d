"""Session and shared-storage helpers used by every subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build(app: str = "symgraph", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and the master is local, a
    temporary one. A cluster without the setting is an error, as its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not getattr(shared_dir, "own", None):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        found = shared_dir.own
    return found.rstrip("/")


#: Most bytes that broadcast_if() sends to every executor.
BROADCAST_BYTES = 8 << 20
#: Paths that shared_path() gave out.
MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below shared_dir()."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def forget(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Deletes what this process has written into the shared folder, from the since-th path on but for some: for the end of
    a job or a stage, when it isn't read any more."""
    keep = [p for p in MADE[since:] if p in but]
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, [p for p in MADE[since:] if p not in but]):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    MADE[since:] = keep


def _sizes(df: DataFrame) -> list[Column]:
    """Rows, and bytes that they take in a broadcast, about."""
    fixed = 16 + 8 * len(df.columns)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(texts, F.lit(fixed).cast("long"))), F.lit(0).cast("long")).alias("bytes")]


def materialise(df: DataFrame, name: str, counted: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage.

    Unlike persist(), the copy outlives executors; unlike checkpoint(), it is columnar and compressed. If counted, rows()
    and broadcast_if() know its size without another job.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if not counted:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    seen = Observation()
    df.observe(seen, *_sizes(df)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._symgraph_held = (seen.get["rows"], seen.get["bytes"])
    return out


def _held(df: DataFrame) -> tuple[int, int]:
    return df.__dict__.get("_symgraph_held") or tuple(df.agg(*_sizes(df)).first())


def rows(df: DataFrame) -> int:
    """The number of rows of a table that is written."""
    return _held(df)[0]


def fits(df: DataFrame, most: int) -> bool:
    """Whether a materialised df is small enough for broadcast_if()."""
    n, size = _held(df)
    return n <= most and size <= BROADCAST_BYTES


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES, else df: a shuffled join.

    df should be materialised, as it is counted where its size isn't known.
    """
    return F.broadcast(df) if fits(df, most) else df


def merged_if(df: DataFrame, most: int) -> DataFrame:
    """broadcast_if(), but with a hint for a sort-merge join where df is larger: Spark would broadcast what it takes for less
    than 10 MB all the same, and the driver holds a broadcast several times over until its plan is gone."""
    return F.broadcast(df) if fits(df, most) else df.hint("merge")


#: Rows and bytes of an Arrow batch between Spark and its Python workers. Texts are long: the usual 10,000 rows would hold
#: tens of megabytes several times over in each worker and, outside the heap, in each executor; and some hundred of the
#: longest would do so, too.
ROWS_IN_BATCH, BYTES_IN_BATCH = 512, 4 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, for a Python function over Arrow batches. Sets its session's batches to ROWS_IN_BATCH rows and BYTES_IN_BATCH at
    most, where they aren't smaller; the settings stay, as the plan runs later."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_IN_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_IN_BATCH)):
        now = str(conf.get(name))
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
