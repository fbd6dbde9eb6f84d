"""Registered queries against their oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
SOME = (
    "blast_radius callers_depth2 neighbourhood_depth2 cycle_detection resolve_symbol resolve_symbol_ranked list_symbols node_cascade_delete edge_ids content_hash repo_compare find_symbol_batch "
    "cross_repo_search rag_evidence rag_prompt context_prompt all_paths shortest_path health_score registry_paths asmdef_parse embed_documents stream_changes extract_csharp extract_csharp_edges extract_design_edges scan_files solution_projects projects owning_projects symbol_by_file nodes_by_file "
    "path_parts find_symbol_fuzzy_indexed implementations_transitive dependencies overrides_recursive model_dimensions unity_projects unity_types_by_text scene_graph prefab_graph assembly_graph addressable_graph event_fields event_edges blast_radius_depth2 pattern_constraints context_compressed hierarchy_diagram "
    "cycle_components depth_first_order pattern_triangles pattern_cycle enclosing_spans embedding_as_of question_entities watcher_state cache_hits project_visibility source_text_search hybrid_rrf extract_terms context_budget chunk_lines vector_topk change_set rename_expand cache_evict json_props carry_forward graph_export"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    df = queries[name](spark, D)
    got = duck.execute(oracles[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(v) for v in r]) for r in got.fetchall())
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 90


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == sum(rows.sparkSession.read.parquet(f"{D}/{t}.parquet").count() for t in ("part", "customer")) + rows.sparkSession.read.parquet(f"{D}/part.parquet").select("p_type").distinct().count()


def test_cases_that_are_more_than_empty(spark):
    queries = __spark_entry__.queries()
    assert {r.node for r in queries["cycle_detection"](spark, D).collect()} == {1, 2, 6, 13, 17, 30}
    radius = queries["blast_radius"](spark, D)
    assert all(radius.where(f"{c} > 0").count() for c in ("callers", "callees", "refs", "tests", "derived", "implementations"))
    health = queries["health_score"](spark, D)
    assert health.where("n_cycle > 0").count() and health.where("n_god > 0").count()


def test_a_missing_dependency_is_not_taken_for_a_missing_subpackage(monkeypatch):
    import builtins
    import importlib

    found = builtins.__import__
    for name, fails in (("corpus_pipeline", False), ("some_other_module", True)):
        def missing(module, *a, name=name, **k):
            if module == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return found(module, *a, **k)
        monkeypatch.setattr(builtins, "__import__", missing)
        if fails:
            with pytest.raises(ModuleNotFoundError):
                importlib.reload(__spark_entry__)
        else:
            assert not any(q.startswith("op") for q in importlib.reload(__spark_entry__).queries())
        monkeypatch.undo()
    importlib.reload(__spark_entry__)
