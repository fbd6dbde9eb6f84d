import hashlib

import pytest

from symgraph.llm import exact

TEXTS = ["é" * 700 + "a", "é" * 700 + "b", "x" * 1000, "short", None, "x" * 1000]


@pytest.mark.parametrize("prime", [exact.PRIME, 3])
def test_parts_of_huge_texts_are_hashed_apart(spark, monkeypatch, prime):
    monkeypatch.setattr(exact, "LARGE", 100)
    monkeypatch.setattr(exact, "PART", 333)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.print, r.text_sha256) for r in exact.fingerprints(docs, prime).collect()}
    datas = [(t or "").encode() for t in TEXTS]
    assert got == {i: (len(d), exact.fingerprint(d, prime), hashlib.sha256(d).hexdigest()) for i, d in enumerate(datas)}
    huge = exact.huge_prints(docs.where("length(text) > 100"), prime).collect()
    assert {r.text_sha256: r.print for r in huge} == {got[i][2]: got[i][1] for i in (0, 1, 2)}
    assert sorted(r.doc_id for r in exact.keep_one(docs).collect()) == [0, 1, 3, 4, 5]
