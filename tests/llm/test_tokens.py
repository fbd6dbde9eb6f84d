import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from symgraph.llm import bpe, tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, part int, ids string, place long"
TEXTS = [(7, "Hello  world's\n\n end "), (3, None), (5, ""), (5, "é漢字 ☃!! 12"), (5, "é漢字 ☃!! 12"), (1, "x" * 30_000), (2, "ab " * 40_000), (None, "nothing"), (9, "<|endoftext|> here"), (4, "\u2028 \x85\x1c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA)


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_library_and_round_trips(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows, enc = TEXTS + [(100 + i, t) for i, t in docs], library()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_decode(frame(spark, rows), RANKS, P.PATTERN).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.encode_decode(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_bpe_edits_and_appends_are_exact():
    random.seed(2)
    v = bpe.Vocabulary(bpe.read_ranks(RANKS))
    e, enc = bpe.Encoder(v, P.PATTERN), library()
    for _ in range(150):
        t = bpe.EditableText(e, P.PATTERN)
        for _ in range(8):
            new = "".join(random.choice("abe  \n'srl12é!?漢") for _ in range(random.randint(0, 12)))
            a = len(t.text) if random.random() < 0.4 else random.randint(0, len(t.text))
            t.replace(a, random.randint(a, min(len(t.text), a + 5)), new)
            assert list(memoryview(t.ids()).cast("I")) == enc.encode_ordinary(t.text)
    for _ in range(100):
        p = bpe.PieceTable(v, bytes(random.choice(b"etionas") for _ in range(300)))
        a = random.randint(0, 200)
        done = p.replace(a, a + random.randint(0, 5), b"er")
        assert p.last == bpe.PieceTable(v, p.piece).last and p.tokens() == bpe.PieceTable(v, p.piece).tokens()
        assert done < 200
    long = bpe.EditableText(e, P.PATTERN, "some words here " * 2000)
    long.replace(10_000, 10_003, "zz")
    assert long.encoded < 20


def test_orc_round_trip(spark):
    enc = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in tokens.round_trip(frame(spark, TEXTS), P.path("byte_bpe_50k.json"), P.PATTERN).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens.round_trip(frame(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_orc_files_are_ordered_and_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "ids")
    tokens.write(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, 2, parts=5)
    rows = tokens.read(spark, path)
    spans = sorted((r.a, r.b) for r in rows.groupBy("part").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "a").join(rows.groupBy("part").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "b"), "part").collect())
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    one = rows.where("doc_id = 17")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()


def read_by(df):
    """Rows that the scan gave when df was collected."""
    assert df.collect() is not None
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_index_and_bloom_filters_spare_rows(spark, tmp_path):
    docs = spark.range(24_000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    path = str(tmp_path / "ids")
    tokens.write(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, 2, parts=2)
    rows = tokens.read(spark, path).select("doc_id", "n_tokens")
    assert read_by(rows) == 24_000
    there, between = rows.where("doc_id = 9000"), rows.where("doc_id = 9001")
    assert there.count() == 1 and read_by(there) <= 2_048  # one row group
    assert read_by(between) == 0  # within all ranges: the Bloom filter knows that it isn't there
    assert read_by(rows.where("doc_id between 100 and 300")) <= 2_048


def test_rows_of_one_id_are_dealt_to_several_parts(spark, tmp_path):
    docs = spark.range(3_000).selectExpr("cast(null as long) as doc_id", "concat(md5(cast(id as string)), ' words') as text")
    path = str(tmp_path / "ids")
    tokens.write(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, 2, parts=4)
    sizes = [r["count"] for r in tokens.read(spark, path).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1_500
