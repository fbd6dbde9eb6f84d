import hashlib
import re

from test_mixing import water
from test_similar import brute_kept

import corpus_pipeline
from symgraph.llm import quality
from symgraph.session import table

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, D, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact dedup", "near dedup", "mixing", "encoding"]
    now, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, D)
        if name != "encoding":
            assert out.schema == docs.schema
            now = spark.createDataFrame(out.collect(), docs.schema)
            rows[name] = [(r.doc_id, r.text) for r in now.collect()]
        else:
            rows[name] = out.collect()
    good = {r.doc_id for r in quality.score(docs, table(spark, D, "labels")).where("predicted = 1").collect()}
    first = {r.doc_id: r.text for r in docs.collect()}
    assert {d for d, _ in rows["quality"]} == good and 0.7 * len(first) < len(good) < len(first)
    best = {}
    for d, t in rows["quality"]:
        best[t] = max(best.get(t, d), d)
    assert sorted(rows["exact dedup"]) == sorted((d, t) for t, d in best.items())
    kept = sorted(rows["exact dedup"])
    assert sorted(d for d, _ in rows["near dedup"]) == brute_kept(kept)
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in rows["near dedup"]}
    sources = sorted({source[d] for d in size})
    total = [sum(n for d, n in size.items() if source[d] == s) for s in sources]
    goal = water(total, [(3, 1, 2)[i % 3] for i in range(len(sources))])
    for s, g in zip(sources, goal, strict=True):
        took = sum(size[d] for d, _ in rows["mixing"] if source[d] == s)
        assert abs(took - g) <= 0.01 * g + 3
    counts = [d for d, _ in rows["mixing"]]
    assert max(map(counts.count, set(counts))) <= 2
    text = dict(rows["near dedup"])
    assert sorted(r.doc_id for r in rows["encoding"]) == sorted(counts)
    for r in rows["encoding"]:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, D).collect()) == sorted(tuple(r)[:4] for r in rows["encoding"])


def test_stages_take_edge_rows(spark):
    docs = table(spark, D, "documents")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 50_000, "en", "a", 5), (None, "some words here", "en", None, 3)]
    for some in (rows, []):
        now = spark.createDataFrame(some, docs.schema).selectExpr("*", "1 as size", "'x' as copies", "2 as gone_id")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, D)
            if name != "encoding":
                assert out.columns == now.columns
                now = spark.createDataFrame(out.collect(), now.schema)
            else:
                assert out.count() == now.count()
