"""The test tables as canonical tables, and the same definitions in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph import session
from symgraph.functions import ids
from symgraph.session import materialise, table

_STORED: dict[tuple, tuple[str, DataFrame]] = {}


def stored(make):
    """make(spark, d), written at its first use in a session: an index is built once and read by all queries."""

    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (make.__name__, spark.sparkContext.applicationId, d)
        if key not in _STORED or _STORED[key][0] not in session.MADE:
            made = materialise(make(spark, d), f"index-{make.__name__}")
            _STORED[key] = (session.MADE[-1], made)
        return _STORED[key][1]

    get.__doc__ = make.__doc__
    return get


def _symbol(full, name, kind, type_name, repository, owner=None, member=False, key=None):
    none = F.lit(None).cast("string")
    up = none if owner is None else ids.node_id(owner)
    return [
        ids.node_id(full if key is None else key).alias("id"), name.alias("name"), full.alias("full_name"), F.lit(kind).alias("kind"), type_name.alias("type_name"), repository.alias("repository"), (none if member else up).alias("container_id"),
        (up if member else none).alias("declaring_type_id"), none.alias("file_path"), F.lit(0).alias("start_line"), none.alias("return_type"),
    ]


@stored
def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Regions are namespaces, nations classes in them, suppliers and customers their methods, parts properties.

    Dealt evenly by id: the tables are so small on disk that one split may hold a million parts, and so would one task of
    each query."""
    c, none = F.col, F.lit(None).cast("string")
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    space = F.concat(F.lit("global::"), "r_name")
    places = nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey"))  # 5 rows
    home = F.concat(space, F.lit("."), "n_name")
    out = region.select(_symbol(space, c("r_name"), "Namespace", none, c("r_name"))).unionByName(places.select(_symbol(home, c("n_name"), "Type", F.lit("Class"), c("r_name"), space)))
    for t, p in (("supplier", "s"), ("customer", "c")):
        rows = table(spark, d, t).join(F.broadcast(places), c(f"{p}_nationkey") == c("n_nationkey"))  # 25 rows
        out = out.unionByName(rows.select(_symbol(F.concat(home, F.lit("."), f"{p}_name"), c(f"{p}_name"), "Method", none, c("r_name"), home, member=True)))
    part = table(spark, d, "part")
    out = out.unionByName(part.select(_symbol(F.concat(F.lit("global::"), "p_brand", F.lit("."), "p_name"), c("p_name"), "Property", c("p_type"), c("p_brand"), key=F.concat(F.lit("part:"), c("p_partkey").cast("string")))))
    return out.repartition(spark.sparkContext.defaultParallelism, "id")


SYMBOLS = """symbols AS (
SELECT md5('global::' || r_name) AS id, r_name AS name, 'global::' || r_name AS full_name, 'Namespace' AS kind, NULL::varchar AS type_name, r_name AS repository, NULL::varchar AS container_id, NULL::varchar AS declaring_type_id FROM region
UNION ALL SELECT md5('global::' || r_name || '.' || n_name), n_name, 'global::' || r_name || '.' || n_name, 'Type', 'Class', r_name, md5('global::' || r_name), NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT md5('global::' || r_name || '.' || n_name || '.' || s_name), s_name, 'global::' || r_name || '.' || n_name || '.' || s_name, 'Method', NULL, r_name, NULL, md5('global::' || r_name || '.' || n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT md5('global::' || r_name || '.' || n_name || '.' || c_name), c_name, 'global::' || r_name || '.' || n_name || '.' || c_name, 'Method', NULL, r_name, NULL, md5('global::' || r_name || '.' || n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT md5('part:' || p_partkey::varchar), p_name, 'global::' || p_brand || '.' || p_name, 'Property', p_type, p_brand, NULL, NULL FROM part)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of types, methods and properties."""
    kind = F.when(F.col("kind") == "Type", F.col("type_name")).otherwise(F.col("kind"))
    meta = F.create_map(F.lit("FilePath"), F.concat("repository", F.lit(".cs")), F.lit("Project"), F.col("repository"))
    return symbols(spark, d).where("kind != 'Namespace'").select("id", "full_name", F.col("name").alias("label"), kind.alias("kind"), "repository", meta.alias("metadata"))


NODES = "nodes AS (SELECT id, full_name, name AS label, CASE WHEN kind = 'Type' THEN type_name ELSE kind END AS kind, repository FROM symbols WHERE kind != 'Namespace')"


def declares(spark: SparkSession, d: str) -> DataFrame:
    """Declares edges from classes to their methods."""
    rows = symbols(spark, d).where("declaring_type_id is not null")
    return rows.select(F.col("declaring_type_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("Declares").alias("kind"), "repository")


DECLARES = "declares AS (SELECT declaring_type_id AS source_id, id AS target_id, 'Declares' AS kind, repository FROM symbols WHERE declaring_type_id IS NOT NULL)"


@stored
def calls(spark: SparkSession, d: str) -> DataFrame:
    """A part calls the part of the next line of an order; ids are part keys."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target_id"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("source_id"), "target_id", F.lit("Calls").alias("kind")).distinct()


CALLS = "calls AS (SELECT DISTINCT a.l_partkey AS source_id, b.l_partkey AS target_id, 'Calls' AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def inherits(spark: SparkSession, d: str) -> DataFrame:
    """Customer k inherits from customer k div 5."""
    rows = table(spark, d, "customer").where("c_custkey > 0")
    return rows.select(F.col("c_custkey").alias("source_id"), F.expr("c_custkey div 5").alias("target_id"), F.lit("Inherits").alias("kind"))


INHERITS = "inherits AS (SELECT c_custkey AS source_id, c_custkey // 5 AS target_id, 'Inherits' AS kind FROM customer WHERE c_custkey > 0)"


def implements(spark: SparkSession, d: str) -> DataFrame:
    """A part implements its type."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_type").alias("target_id"), F.lit("Implements").alias("kind"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Order lines refer to parts."""
    kind = F.when(F.col("l_returnflag") == "R", "Call").when(F.col("l_returnflag") == "A", "Read").otherwise("Type")
    context = F.concat(F.lit("Line "), "l_linestatus", F.when(F.col("l_linenumber") == 7, " Test").otherwise(""))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("source_symbol_id"), F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"), kind.alias("kind"), context.alias("context"))


REFS = "refs AS (SELECT l_partkey AS symbol_id, l_suppkey AS source_symbol_id, l_orderkey::varchar AS file_path, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'Call' WHEN 'A' THEN 'Read' ELSE 'Type' END AS kind, 'Line ' || l_linestatus || CASE WHEN l_linenumber = 7 THEN ' Test' ELSE '' END AS context FROM lineitem)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their source."""
    return table(spark, d, "documents").select(F.col("source").alias("repository"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), "doc_id")


FILES = "files AS (SELECT source AS repository, source || '/' || doc_id::varchar AS file_path, text AS content, doc_id FROM documents)"


@stored
def text_index(spark: SparkSession, d: str) -> DataFrame:
    """The files' posting lists."""
    from symgraph.operators import search

    return search.text_index(files(spark, d))


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the files: every tenth is gone, every seventh changed, and as many new ones as are gone."""
    f = files(spark, d)
    old = f.select("file_path", F.md5("content").alias("hash"), "repository")
    left = f.where("doc_id % 10 != 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("content", F.lit("!")))).otherwise(F.md5("content")).alias("hash"), "repository")
    new = f.where("doc_id % 10 = 0").select(F.concat("repository", F.lit("/new"), F.col("doc_id").cast("string")).alias("file_path"), F.md5("content").alias("hash"), "repository")
    return old, left.unionByName(new)


MANIFESTS = """old_m AS (SELECT file_path, md5(content) AS hash, repository FROM files),
new_m AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN md5(content || '!') ELSE md5(content) END AS hash, repository FROM files WHERE doc_id % 10 != 0
 UNION ALL SELECT repository || '/new' || doc_id::varchar, md5(content), repository FROM files WHERE doc_id % 10 = 0)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as one collection; the label is payload."""
    return table(spark, d, "embeddings").select(F.lit("all").alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """What users said."""
    return table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("question"), "conv_id", "turn")


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
