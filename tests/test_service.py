"""Indexes of repositories and the tool calls on them."""

import json

import pytest
from test_sources import GAME

from symgraph.plans.service import Index, Tools


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    for name, body in GAME.items():
        (path / name).parent.mkdir(exist_ok=True)
        (path / name).write_text(body)
    t = Tools(spark)
    t.path = path
    (row,) = t.tool_index_repository(f"file://{path}", "game")
    assert (row["files"], row["symbols"], row["nodes"], row["edges"]) == (5, 18, 17, 15)
    t.index = Index(**{k: df.cache() for k, df in t.index.tables().items()})
    return t


def call(tools, tool, **arguments):
    out = tools.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    assert "result" in out, out
    text = out["result"]["content"][0]["text"]
    return json.loads(text) if text[0] in "[{" else text


def test_protocol(tools):
    assert tools.handle({"method": "notifications/initialized"}) is None
    assert tools.handle({"id": 3, "method": "initialize"})["result"]["serverInfo"]["name"] == "symgraph"
    assert len(tools.handle({"id": 4, "method": "tools/list"})["result"]["tools"]) >= 25
    code = lambda r: tools.handle(r)["error"]["code"]
    assert code({"id": 5, "method": "nope"}) == -32601 and code({"id": 6, "method": "tools/call", "params": {"name": "nope"}}) == -32602
    assert code({"id": 7, "method": "tools/call", "params": {"name": "find_symbol"}}) == -32602


def test_lookups(tools):
    assert [r["kind"] for r in call(tools, "find_symbol", name="Fire")] == ["Method"]
    assert [r["full_name"] for r in call(tools, "find_callers", name="Spawn", depth=2)] == ["global::TestGame.Weapon.Fire", "global::TestGame.PlayerController.Attack"]
    assert len(call(tools, "find_callees", name="Attack", depth=2)) == 2 and len(call(tools, "trace_execution_flow", name="Attack")) == 2
    assert [r["full_name"] for r in call(tools, "find_implementations", name="IDamageable")] == ["global::TestGame.Enemy"]
    assert call(tools, "find_derived_types", name="Enemy") == [] and len(call(tools, "find_references", name="Fire")) == 2
    assert call(tools, "search_symbols", query="Player")[0]["name"] == "PlayerController"
    assert call(tools, "recent_symbols")[0].startswith("global::")
    assert len(call(tools, "list_symbols", kind="interface")) == 1 and len(call(tools, "search_graph", text="weapon")) >= 1


def test_reports(tools):
    (r,) = call(tools, "blast_radius", symbolName="Fire")
    assert (r["callers"], r["callees"], r["level"]) == (1, 1, "MINIMAL")
    assert call(tools, "get_symbol_info", name="Fire")[0]["refs"] == 2
    assert call(tools, "explain_architecture")[0]["methods"] == 6 and call(tools, "graph_stats")[0]["n"] == 6
    assert call(tools, "mermaid").startswith("graph TD") and len(call(tools, "graph_export")["edges"]) == 15
    assert call(tools, "health", repository="game")[0]["score"] == 100
    assert "### global::TestGame.Weapon.Fire" in call(tools, "ask", question="What does Fire do?")[0]["prompt"]
    assert call(tools, "build_context", question="What does Fire do?")[0]["symbols"] >= 1
    assert any(r["source"] == "text" for r in call(tools, "search_code", query="Spawn"))


def test_whole_results_and_pages(spark, tools):
    nodes, edges = call(tools, "graph_nodes", kind="method"), call(tools, "graph_edges", kind="declares")
    assert len(nodes) == 6 and len(edges) == 12 and [n["full_name"] for n in nodes] == sorted(n["full_name"] for n in nodes)
    assert call(tools, "graph_nodes", kind="method", limit=2, offset=3) == nodes[3:5] and len(call(tools, "graph_export", limit=4)["nodes"]) == 4
    more = tools.index.nodes.crossJoin(spark.range(40).withColumnRenamed("id", "k")).drop("k")
    wide = Tools(spark, Index(**{**tools.index.tables(), "nodes": tools.index.nodes.unionByName(more)}))
    assert len(wide.tool_graph_nodes("Method")) == 6 * 41
    assert len(call(tools, "compare_symbols", first="game", second="none", status="UniqueToFirst")) == 18
    assert "## Relevant Symbols" in call(tools, "context_prompt", question="What does Fire do?")[0]["prompt"]


def test_status_and_health(spark, tools, tmp_path):
    assert call(tools, "index_status", repository="game")["status"] == "Indexed" and call(tools, "index_status", repository="other")["status"] == "Unknown"
    deep = spark.createDataFrame([("d.cs", "namespace N { " * 3000, ".cs"), ("e.cs", "class E {}", ".cs")], "file_path string, content string, ext string")
    (row,) = Index.of_files(deep, "deep").counts().collect()
    assert (row.files, row.symbols, row.unreadable) == (2, 1, 1)
    said = call(tools, "health_check")
    assert said["status"] in ("Healthy", "Degraded") and {c["name"]: c["status"] for c in said["checks"]}["extractor"] == "Healthy"


def test_command_line(spark, tools, tmp_path, capsys):
    from symgraph.__main__ import main

    out = str(tmp_path / "stored")
    assert main([f"file://{tools.path}", "--repository", "cli", "--out", out, "--call", "find_symbol", "name=Fire"]) == 0
    first, second = capsys.readouterr().out.strip().splitlines()
    assert json.loads(first)["symbols"] == 18 and json.loads(second)[0]["kind"] == "Method"
    assert main([out, "--stored", "--call", "nope"]) == 1 and main([str(tmp_path / "none"), "--stored"]) == 1


def test_refresh_reads_changed_files_only(spark, tools, monkeypatch):
    from symgraph.sources import csharp

    seen, extract = [], csharp.extract
    monkeypatch.setattr(csharp, "extract", lambda files: seen.append(sorted(r.file_path for r in files.collect())) or extract(files))
    files = [(r.file_path, "namespace TestGame; public class Enemy { void Go() { new Weapon().Fire(); } }" if "Enemy" in r.file_path else r.content, ".cs") for r in tools.index.files.collect() if "IDamage" not in r.file_path]
    now = tools.index.refresh(spark.createDataFrame(files, "file_path string, content string, ext string"), "game")
    assert [len(s) for s in seen] == [1] and "Enemy" in seen[0][0]
    whole = Index.of_files(spark.createDataFrame(files, "file_path string, content string, ext string"), "game")
    for k in ("symbols", "nodes", "edges"):
        assert sorted(r.id for r in getattr(now, k).collect()) == sorted(r.id for r in getattr(whole, k).collect())


def test_several_repositories(spark, tools, tmp_path):
    copy = Index.of_path(spark, f"file://{tools.path}", "copy")
    both = tools.index.add(copy)
    t = Tools(spark, both)
    assert t.tool_compare("game", "copy") == [{"common": 18, "unique_one": 0, "unique_two": 0}]
    assert {r["repository"] for r in t.tool_search_across("Player")} == {"game", "copy"} and len(t.tool_list_repositories()) == 2
    t.tool_remove_repository("copy")
    assert len(t.tool_list_repositories()) == 1
    both.save(str(tmp_path / "i"))
    assert Index.load(spark, str(tmp_path / "i")).symbols.count() == 36
    files = spark.createDataFrame([(r.file_path, r.content if "Enemy" not in r.file_path else "class Enemy {}", ".cs") for r in tools.index.files.collect()], "file_path string, content string, ext string")
    assert tools.index.refresh(tools.index.files.drop("hash"), "game").symbols.count() == 18
    assert tools.index.refresh(files, "game").only("game").symbols.count() == 16
