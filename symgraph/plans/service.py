"""Repositories as indexes, and the tool calls that are answered from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators import analysis, graph, retrieval, search, tables
from symgraph.plans import export
from symgraph.session import broadcast_if, materialise, shared_dir
from symgraph.session import rows as rows_of
from symgraph.sources import csharp
from symgraph.sources import files as S

SHARED = ("id", "name", "full_name", "kind", "type_name", "container_id", "declaring_type_id", "file_path", "start_line", "end_line", "return_type", "access", "bases", "attributes", "owner", "namespace", "parameters", "metadata")


TABLES = ("files", "rows", "symbols", "refs", "nodes", "edges")
# Fixed value: megabytes of the driver's heap from which on health is degraded.
MEMORY_MB = 1000
#: Rows that a tool call gives where the caller names no limit; export.as_json() and files.save() write whole tables.
PAGE = 1000


@dataclass(frozen=True)
class Index:
    """Lazy tables of any number of repositories; each has a repository column."""

    files: DataFrame
    rows: DataFrame
    symbols: DataFrame
    refs: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of_files(cls, files: DataFrame, repository: str) -> Index:
        """Extracts, resolves and links the .cs files of one repository."""
        return cls.of_rows(files, csharp.extract(files), repository)

    @classmethod
    def of_rows(cls, files: DataFrame, rows: DataFrame, repository: str) -> Index:
        """Resolves and links the extractor's rows of all files."""
        rows = materialise(rows, "extract")
        s = materialise(csharp.symbols_of(rows), "symbols")
        found = materialise(csharp.resolve(rows, s), "resolved")
        mark = lambda df: df.withColumn("repository", F.lit(repository))
        return cls(mark(files.drop("repository")), mark(rows), mark(s.select(*SHARED)), mark(csharp.refs_of(found)), mark(csharp.nodes_of(s)), mark(materialise(csharp.edges_of(s, found, rows), "edges")))

    @classmethod
    def of_path(cls, spark: SparkSession, path: str, repository: str) -> Index:
        """Scans a folder and indexes it."""
        return cls.of_files(S.scan(spark, path, repository=repository), repository)

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in TABLES}

    def add(self, other: Index) -> Index:
        """With another index's repositories, which replace those of the same name."""
        names = other.symbols.select("repository").distinct()
        return Index(**{k: df.join(names, "repository", "left_anti").unionByName(other.tables()[k], allowMissingColumns=True) for k, df in self.tables().items()})

    def remove(self, repository: str) -> Index:
        return Index(**{k: df.where(F.col("repository") != repository) for k, df in self.tables().items()})

    def only(self, repository: str) -> Index:
        return Index(**{k: df.where(F.col("repository") == repository) for k, df in self.tables().items()})

    def refresh(self, files: DataFrame, repository: str) -> Index:
        """E21, ST5: only the repository's new and modified files are read again, rows of deleted ones go; what all files say
        of others is linked anew, by joins, as names may now mean something else. Unchanged repositories are left alone."""
        old = self.only(repository)
        changes = materialise(S.change_set(S.manifest(old.files), S.manifest(files)), "changes", True)
        if not rows_of(changes):
            return self
        fresh = csharp.extract(files.join(broadcast_if(changes.where("change_type != 'Deleted'").select("file_path"), 100_000), "file_path", "left_semi"))
        kept = old.rows.drop("repository").join(changes.select("file_path"), "file_path", "left_anti")
        return self.add(Index.of_rows(files, kept.unionByName(fresh), repository))

    def counts(self) -> DataFrame:
        """One row a repository: files, symbols, nodes, edges (RepoIndex)."""
        n = lambda k: self.tables()[k].groupBy("repository").agg(F.count(F.lit(1)).alias(k))
        out = n("symbols")
        for k in ("files", "nodes", "edges"):
            out = out.join(n(k), "repository", "full_outer")
        errors = self.rows.groupBy("repository").agg(F.count_if(F.col("row") == "error").alias("unreadable"))
        return out.join(errors, "repository", "left").fillna(0)

    def save(self, path: str) -> None:
        """K1, K2, K7: full schemas, a folder a table, partitioned by repository."""
        for k, df in self.tables().items():
            S.save(df, f"{path}/{k}", "repository")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """S10, S11."""
        return cls(**{k: S.load(spark, f"{path}/{k}") for k in TABLES})


class Tools:
    """Answers tool calls; a tool takes arguments and returns rows, as lists of dictionaries, or a text."""

    def __init__(self, spark: SparkSession, index: Index | None = None):
        self.spark, self.index = spark, index
        self.recent: list[str] = []
        self.tools: dict[str, Callable] = {n.removeprefix("tool_"): getattr(self, n) for n in dir(self) if n.startswith("tool_")}

    # protocol -------------------------------------------------------------------------------------------------------

    def handle(self, request: dict) -> dict | None:
        """One JSON-RPC request; null for notifications. Unknown methods give -32601, unknown tools and missing
        arguments -32602, failures -32603."""
        method, number = request.get("method", ""), request.get("id")
        if method.startswith("notifications/"):
            return None
        answer = lambda **x: {"jsonrpc": "2.0", "id": number} | x
        error = lambda code, text: answer(error={"code": code, "message": text})
        if method == "initialize":
            return answer(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "symgraph", "version": "1"}})
        if method == "tools/list":
            return answer(result={"tools": [{"name": n, "description": (f.__doc__ or "").strip()} for n, f in sorted(self.tools.items())]})
        if method != "tools/call":
            return error(-32601, f"Unknown method: {method}")
        params = request.get("params") or {}
        tool = self.tools.get(params.get("name"))
        if tool is None:
            return error(-32602, f"Unknown tool: {params.get('name')}")
        try:
            found = tool(**(params.get("arguments") or {}))
        except TypeError as e:
            return error(-32602, str(e))
        except Exception as e:
            return error(-32603, str(e)[:500])
        return answer(result={"content": [{"type": "text", "text": found if isinstance(found, str) else json.dumps(found, default=str, ensure_ascii=False)}]})

    def _seed(self, name: str) -> DataFrame:
        """The symbol that a name means (P10), as a seed."""
        found = tables.resolve_ranked(self.index.symbols, self.spark.createDataFrame([(name,)], "query string")).select(F.col("id").alias("seed"), "full_name").collect()
        self.recent = [r["full_name"] for r in found if r["full_name"] not in self.recent] + self.recent
        del self.recent[10:]
        return self.spark.createDataFrame([(r["seed"],) for r in found], "seed string")

    def _named(self, found: DataFrame, most: int = 20, offset: int = 0) -> list[dict]:
        rows = found.join(self.index.symbols.select(F.col("id").alias("node"), "full_name", "file_path", "start_line"), "node").orderBy("depth", "full_name", "file_path", "start_line").offset(offset).limit(most)
        return [r.asDict() for r in rows.select("full_name", "depth", "file_path", "start_line").collect()]

    def _rows(self, df: DataFrame, most: int = PAGE, offset: int = 0) -> list[dict]:
        return [r.asDict(recursive=True) for r in (df.offset(offset) if offset else df).limit(most).collect()]

    # tools ----------------------------------------------------------------------------------------------------------

    def tool_index_repository(self, path: str, repository: str = "repo") -> list[dict]:
        """Index a folder; a repository of the same name is replaced."""
        new = Index.of_path(self.spark, path, repository)
        self.index = new if self.index is None else self.index.add(new)
        return self._rows(self.index.only(repository).counts())

    def tool_index_status(self, repository: str) -> dict:
        """Whether a repository is indexed, its counts, and the files that could not be read."""
        i = None if self.index is None else self.index.only(repository)
        counts = [] if i is None else self._rows(i.counts())
        return {"repository": repository, "status": "Indexed" if counts else "Unknown"} | (counts[0] | {"errors": self._rows(csharp.errors_of(i.rows).orderBy("file_path"))} if counts else {})

    def tool_refresh_repository(self, path: str, repository: str = "repo") -> list[dict]:
        """Index what has changed in a folder since it was indexed."""
        self.index = self.index.refresh(S.scan(self.spark, path, repository=repository), repository)
        return self._rows(self.index.only(repository).counts())

    def tool_health_check(self) -> dict:
        """Whether the extractor works, the shared folder can be reached, and memory is free."""
        checks = {}
        try:
            checks["extractor"] = ("Healthy" if csharp.read_file("probe.cs", "struct Probe { int n; }") else "Unhealthy", "reads a struct")
        except Exception as e:
            checks["extractor"] = ("Unhealthy", str(e)[:200])
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        used = (runtime.totalMemory() - runtime.freeMemory()) / (1 << 20)
        checks["memory"] = ("Healthy" if used < MEMORY_MB else "Degraded", f"Memory: {used:.1f} MB")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(shared_dir(self.spark))
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        checks["storage"] = ("Healthy" if there else "Degraded", str(folder))
        said = {x for x, _ in checks.values()}
        return {"status": next(x for x in ("Unhealthy", "Degraded", "Healthy") if x in said), "checks": [{"name": k, "status": x, "description": y} for k, (x, y) in checks.items()]}

    def tool_list_repositories(self) -> list[dict]:
        """Counts of each repository."""
        return self._rows(self.index.counts().orderBy("repository"))

    def tool_remove_repository(self, repository: str) -> str:
        """Forget a repository."""
        self.index = self.index.remove(repository)
        return "removed"

    def tool_list_symbols(self, kind: str | None = None, name: str | None = None) -> list[dict]:
        """Symbols of a kind whose name contains a text."""
        return self._rows(tables.list_symbols(self.index.symbols.select("id", "name", "full_name", "kind", "type_name"), kind, name))

    def tool_find_symbol(self, name: str) -> list[dict]:
        """Symbols of exactly this name."""
        return self._rows(tables.by_name(self.index.symbols, name).select("full_name", "kind", "file_path", "start_line").orderBy("full_name"), 20)

    def tool_search_symbols(self, query: str, limit: int = 20, kind: str | None = None) -> list[dict]:
        """Symbols by full name, name, prefix and trigrams."""
        return self._rows(search.find_symbols(self.index.symbols, self.spark.createDataFrame([(query,)], "query string"), limit, kind=kind).orderBy(F.desc("score"), "full_name"), limit)

    def tool_search_across(self, query: str, limit: int = 20) -> list[dict]:
        """The best symbols over all repositories."""
        return self._rows(search.find_across(self.index.symbols, self.spark.createDataFrame([(query,)], "query string"), limit), limit)

    def tool_find_references(self, name: str) -> list[dict]:
        """Places that refer to a symbol."""
        return self._rows(self.index.refs.join(self._seed(name), F.col("symbol_id") == F.col("seed")).select("file_path", "line", "column", "kind", "context").orderBy("file_path", "line", "column"), 20)

    def tool_find_callers(self, name: str, depth: int = 1) -> list[dict]:
        """Who calls a method."""
        return self._named(graph.callers(self.index.edges, self._seed(name), depth, self.index.nodes))

    def tool_find_callees(self, name: str, depth: int = 1) -> list[dict]:
        """What a method calls."""
        return self._named(graph.callees(self.index.edges, self._seed(name), depth, self.index.nodes))

    def tool_find_implementations(self, name: str) -> list[dict]:
        """Types that implement an interface."""
        return self._named(graph.implementations(self.index.edges, self._seed(name), self.index.nodes))

    def tool_find_derived_types(self, name: str) -> list[dict]:
        """Types below a type."""
        return self._named(graph.derived_types(self.index.edges, self._seed(name), self.index.nodes))

    def tool_find_overrides(self, name: str) -> list[dict]:
        """Methods that override a method."""
        return self._named(graph.overrides(self.index.edges, self._seed(name)))

    def tool_find_dependencies(self, name: str, depth: int = 2) -> list[dict]:
        """What a symbol needs: what it calls, its bases and interfaces."""
        return self._named(graph.bfs(self.index.edges, self._seed(name), depth, "out", ("Calls", "Inherits", "Implements", "DependsOn", "Uses")))

    def tool_trace_execution_flow(self, name: str, depth: int = 3, limit: int = PAGE, offset: int = 0) -> list[dict]:
        """A page of the calls that a method leads to, by depth."""
        return self._named(graph.callees(self.index.edges, self._seed(name), depth), limit, offset)

    def tool_search_graph(self, text: str, kinds: list[str] | None = None, limit: int = PAGE, offset: int = 0) -> list[dict]:
        """Nodes whose label or kind contains a text, a page at a time."""
        return self._rows(tables.search_nodes(self.index.nodes, text, kinds).select("label", "full_name", "kind").orderBy("full_name", "kind", "label"), limit, offset)

    def tool_search_code(self, query: str) -> list[dict]:
        """Symbols and source lines."""
        rows = search.search_code(self.index.symbols, self.index.files.where("ext = '.cs'"), self.spark.createDataFrame([(query,)], "query string"))
        return self._rows(rows.orderBy(F.desc("score"), "source", "place"), 40)

    def tool_get_symbol_info(self, name: str) -> list[dict]:
        """Counts of callers, callees and references."""
        return self._rows(self._radius(name, 1).select("full_name", "kind", "callers", "callees", "refs"))

    def tool_blast_radius(self, symbolName: str, depth: int = 2) -> list[dict]:  # noqa: N803
        """What a change of a symbol would touch, with a risk score."""
        return self._rows(self._radius(symbolName, depth))

    def _radius(self, name: str, depth: int) -> DataFrame:
        return analysis.blast_radius(self.index.symbols, self.index.edges, self.index.refs, self._seed(name), depth)

    def tool_explain_architecture(self) -> list[dict]:
        """Counts of symbols by kind, by repository."""
        return self._rows(analysis.repository_stats(self.index.symbols))

    def tool_graph_stats(self) -> list[dict]:
        """Counts of nodes by kind."""
        return self._rows(analysis.counts_by_kind(self.index.nodes))

    def tool_graph_nodes(self, kind: str, limit: int = PAGE, offset: int = 0) -> list[dict]:
        """Nodes of a kind by full name and id, a page at a time."""
        return self._rows(self.index.nodes.where(F.lower("kind") == kind.lower()).select("id", "label", "full_name", "kind").orderBy("full_name", "id"), limit, offset)

    def tool_graph_edges(self, kind: str, limit: int = PAGE, offset: int = 0) -> list[dict]:
        """Edges of a kind by their ends, a page at a time."""
        return self._rows(self.index.edges.where(F.lower("kind") == kind.lower()).select("source_id", "target_id", "kind", "weight").orderBy("source_id", "target_id"), limit, offset)

    def tool_graph_export(self, limit: int = PAGE, offset: int = 0) -> dict:
        """Nodes and edges with labels and colours, a page of each; export.as_json() writes all of them."""
        n, e = export.graph_nodes(self.index.nodes), export.graph_edges(self.index.nodes, self.index.edges)
        return {"nodes": self._rows(n.orderBy("id"), limit, offset), "edges": self._rows(e.orderBy("source_id", "target_id", "kind"), limit, offset)}

    def tool_mermaid(self) -> str:
        """A diagram of the graph."""
        return export.mermaid(self.index.nodes, self.index.edges).first()["mermaid"]

    def tool_ask(self, question: str) -> list[dict]:
        """The prompt that evidence from the graph gives for a question."""
        q = self.spark.createDataFrame([(question,)], "question string")
        found = retrieval.evidence(self.index.symbols, self.index.edges, q)
        return self._rows(retrieval.prompts(found, self.index.symbols, graph.relationships(self.index.symbols, self.index.nodes, self.index.edges)))

    def tool_build_context(self, question: str) -> list[dict]:
        """Symbols, relationships, tokens and confidence for a question."""
        q = self.spark.createDataFrame([(question,)], "question string")
        return self._rows(retrieval.context_summary(q, *retrieval.context(self.index.symbols, self.index.edges, q)))

    def tool_compare(self, first: str, second: str) -> list[dict]:
        """Counts of common and unique symbols of two repositories."""
        return self._rows(analysis.compare_counts(self.index.symbols, first, second))

    def tool_compare_symbols(self, first: str, second: str, status: str | None = None, limit: int = PAGE, offset: int = 0) -> list[dict]:
        """The symbols of two repositories, each Common, UniqueToFirst or UniqueToSecond."""
        rows = analysis.compare(self.index.symbols, first, second).orderBy("status", "full_name")
        return self._rows(rows if status is None else rows.where(F.col("status") == status), limit, offset)

    def tool_context_prompt(self, question: str) -> list[dict]:
        """The prompt that the context of a question gives."""
        q = self.spark.createDataFrame([(question,)], "question string")
        return self._rows(retrieval.context_prompts(q, *retrieval.context(self.index.symbols, self.index.edges, q), self.index.symbols))

    def tool_health(self, repository: str) -> list[dict]:
        """Score, warnings and suggestions of a repository."""
        i = self.index.only(repository)
        return self._rows(analysis.health(i.symbols, i.nodes, i.edges))

    def tool_recent_symbols(self) -> list[str]:
        """The last ten symbols asked for."""
        return list(self.recent)

