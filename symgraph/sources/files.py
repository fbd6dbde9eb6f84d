"""File scans, projects, change sets, and stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.functions.text import dirname, extension, segments_outside

# What a scan reads and leaves out.
EXTENSIONS = (".cs", ".csproj", ".sln")
EXCLUDED = (".git", "bin", "obj", "node_modules", ".vs", "packages", "Library", "Temp", "Logs", "UserSettings")
LARGEST = 10 * 1024 * 1024


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED, largest: int = LARGEST, repository: str = "") -> DataFrame:
    """Files below path: repository, file_path, ext, content, size, hash, line_count."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    kept = raw.where((F.col("length") <= largest) & extension(F.col("path")).isin(*extensions) & segments_outside(F.col("path"), list(excluded)))
    text = F.decode("content", "UTF-8")
    return kept.select(F.lit(repository).alias("repository"), F.col("path").alias("file_path"), extension(F.col("path")).alias("ext"), text.alias("content"), F.col("length").alias("size"), F.base64(F.unhex(F.sha2("content", 256))).alias("hash"), F.size(F.split(text, "\n", -1)).alias("line_count"))


def solution_projects(files: DataFrame) -> DataFrame:
    """file_path, project of each Project line of a solution."""
    found = F.regexp_extract_all("content", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"'), 1)
    return files.where("ext = '.sln'").select("file_path", F.explode(found).alias("project"))


def projects(files: DataFrame) -> DataFrame:
    """Project, dir, target_framework of each project file."""
    tfm = F.xpath_string("content", F.lit("//*[local-name()='TargetFramework'][1]"))
    return files.where("ext = '.csproj'").select(F.col("file_path").alias("project"), dirname(F.col("file_path")).alias("dir"), F.when(F.coalesce(tfm, F.lit("")) == "", "net10.0").otherwise(tfm).alias("target_framework"))


def owning_project(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with the project in the nearest folder above; without one, the first project.

    A file is joined once for each folder above it, so no pair of file and project is made that doesn't fit."""
    parts = F.split(dirname(F.col("file_path")), "/")
    above = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"))
    hits = above.join(found.select(F.lower("dir").alias("low"), "project"), F.lower("dir") == F.col("low")).groupBy("file_path").agg(F.max_by(F.struct("project"), F.length("dir")).alias("best"))
    first = found.agg(F.min("project").alias("first_project"))
    return files.join(hits, "file_path", "left").crossJoin(first).withColumn("project", F.coalesce("best.project", "first_project")).drop("best", "first_project")  # with one row


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, change_type (New, Modified or Deleted), hash of two manifests (file_path, hash)."""
    rows = old.select("file_path", F.col("hash").alias("was")).join(new.select("file_path", F.col("hash").alias("now")), "file_path", "full_outer")
    kind = F.when(F.col("was").isNull(), "New").when(F.col("now").isNull(), "Deleted").when(F.col("was") != F.col("now"), "Modified")
    return rows.withColumn("change_type", kind).where("change_type is not null").select("file_path", "change_type", F.col("now").alias("hash"))


def change_totals(changes: DataFrame) -> DataFrame:
    """A19."""
    counts = [F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("New", "Modified", "Deleted")]
    return changes.agg(*counts, F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) > 0).alias("has_changes"))


def apply_changes(rows: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """ST4, ST5, K1: rows of changed files are replaced by fresh ones; running it again changes nothing."""
    kept = rows.join(changes.select("file_path").distinct(), "file_path", "left_anti")
    new = fresh.join(changes.where("change_type != 'Deleted'").select("file_path").distinct(), "file_path", "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Id, change (Added, Modified or Removed) of symbols (id, code_hash)."""
    rows = old.select("id", F.col("code_hash").alias("was"), F.lit(1).alias("o")).join(new.select("id", F.col("code_hash").alias("now"), F.lit(1).alias("n")), "id", "full_outer")
    kind = F.when(F.col("o").isNull(), "Added").when(F.col("n").isNull(), "Removed").when(~F.col("was").eqNullSafe(F.col("now")), "Modified")
    return rows.select("id", kind.alias("change")).where("change is not null")


def affected(changed: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols that refer to changed ones."""
    return refs.join(changed.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("source_symbol_id").distinct()


def save(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """K1, K2, K7, K8: overwrites a table; with a partition column, only the partitions that rows have."""
    if partition:
        rows.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def save_bucketed(rows: DataFrame, name: str, key: str, buckets: int = 64, partition: str | None = None) -> None:
    """K3, H3: a managed table whose joins on key need no shuffle."""
    writer = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)


def load(spark: SparkSession, path: str) -> DataFrame:
    """S10, S11, S15, K4."""
    return spark.read.parquet(path)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table has rows; false if there is none."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def register_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """K6: the registry of repository paths, one for each spelling but for case; the older one stays."""
    rows = old.select("path", F.lit(0).alias("age")).unionByName(new.select("path", F.lit(1).alias("age")))
    w = Window.partitionBy(F.lower("path")).orderBy("age", "path")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("path")


def unregister(registry: DataFrame, name: str) -> DataFrame:
    """K6: without the paths whose last part is name."""
    return registry.where(F.lower(F.regexp_extract("path", r"([^/\\]+)[/\\]*$", 1)) != name.lower())


def manifest(files: DataFrame) -> DataFrame:
    """file_path, hash."""
    return files.select("file_path", F.coalesce("hash", ids.file_hash(F.col("content"))).alias("hash")) if "hash" in files.columns else files.select("file_path", ids.file_hash(F.col("content")).alias("hash"))


def metadata_value(column: str, key: str) -> Column:
    """A value of a map, or null."""
    return F.try_element_at(column, F.lit(key))
