import gzip
import hashlib
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from symgraph.llm import urls, warc

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, host string, file int")


def canonical(u):
    return f'<html><head><LINK href="{u}" REL=canonical></head></html>'


PAGES = [
    (1, "http://A.Example.net/x?q#f", None), (2, "https://a.example.net/en/", ""), (3, "https://example.com/de/1", "x"), (4, "https://badexample.com/de/1", "x"),
    (5, "https://b.org/fr/", canonical("http://evil.net/z")), (6, "http://ok.org/a", canonical("http://evil.net/z")), (7, "http://mid.org/b", '<meta http-equiv="refresh" content="0; url=http://ok.org/a">'),
    (8, "http://far.org/c", canonical("http://mid.org/b")), (9, None, canonical("http://evil.net/z")), (10, "no scheme", None), (11, "http://", ""), (12, "a://b://c.net/", None), (13, "http://x.net", None),
    (14, "http://c.org/p", canonical("/q?a=1&amp;b=2")), (15, "http://c.org/q?a=1&b=2", canonical("//deep.net/")), (16, "http://lone.org/p", "<!-- " + canonical("http://evil.net/z") + " -->"), (8, "http://far.org/c", canonical("http://mid.org/b")),
    (17, "http://u.org/1", canonical("http://v.example.net/en/2")), (18, "http://u.org/2", canonical("http://u.org/1")), (19, "http://u.org/2", canonical("http://w.net/")), (None, "HTTP://Ü.NET/", "é" * 10),
]


def test_hosts_paths_and_rules(spark):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(frame(spark, PAGES), urls.rules_table(spark, RULES)).collect()}
    assert got == {
        (1, "a.example.net", "/x"): ("net/", "block"), (2, "a.example.net", "/en/"): ("example.net/en/", "allow"), (3, "example.com", "/de/1"): ("example.com/de/", "block"), (4, "badexample.com", "/de/1"): (None, "allow"),
        # 5 to 8 are aliases of a blocked url, and one of them is allowed: that takes precedence
        (5, "b.org", "/fr/"): ("org/fr/", "allow"), (6, "ok.org", "/a"): (None, "allow"), (7, "mid.org", "/b"): (None, "allow"), (8, "far.org", "/c"): (None, "allow"),
        (9, "", ""): (None, "allow"), (10, "", ""): (None, "allow"), (11, "", ""): (None, "allow"), (12, "b:", "//c.net/"): (None, "allow"), (13, "x.net", ""): (None, "allow"),
        (14, "c.org", "/p"): (None, "block"), (15, "c.org", "/q"): (None, "block"), (16, "lone.org", "/p"): (None, "allow"),
        (17, "u.org", "/1"): (None, "allow"), (18, "u.org", "/2"): (None, "allow"), (19, "u.org", "/2"): (None, "allow"), (None, "Ü.net", "/"): ("net/", "block"),
    }


def test_many_rules_are_joined_to_the_same_effect(spark, monkeypatch):
    few = sorted(map(str, urls.judge(frame(spark, PAGES), urls.rules_table(spark, RULES)).collect()))
    monkeypatch.setattr(urls, "RULES_IN_PLAN", 1)
    assert sorted(map(str, urls.judge(frame(spark, PAGES), urls.rules_table(spark, RULES)).collect())) == few


def test_allow_wins_among_rules_of_one_length(spark, monkeypatch):
    rules = spark.createDataFrame([("a.com", "/", "block"), ("a.com", "/", "allow"), ("b.com", "/xy", "block"), ("a.b.com", "/", "allow"), ("c.com", "/", "block"), ("c.com", "/", "block"), ("d.com", None, "block"), (None, "/", "block"), ("e.com", "/", None)], "host string, path string, verdict string")
    pages = frame(spark, [(i, f"http://{u}", None) for i, u in enumerate(("a.com/", "a.b.com/xyz", "c.com/", "d.com/", "e.com/"))])
    want = {0: ("a.com/", "allow"), 1: ("a.b.com/", "allow"), 2: ("c.com/", "block"), 3: (None, "allow"), 4: (None, "allow")}
    for most in (2_000, 1):
        monkeypatch.setattr(urls, "RULES_IN_PLAN", most)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == want


def test_known_redirects_and_empty_tables(spark):
    pages = frame(spark, [(1, "http://a.org/", None), (2, "http://b.org/", None)])
    edges = spark.createDataFrame([("a.org/", "t.co/1"), ("t.co/1", "spam.net/")], "u string, v string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, urls.rules_table(spark, RULES), edges).collect()} == {1: "block", 2: "allow"}
    assert urls.judge(frame(spark, []), urls.rules_table(spark, RULES)).count() == 0
    assert urls.judge(pages, urls.rules_table(spark, RULES).limit(0)).where("rule is null and verdict = 'allow'").count() == 2


def test_plain_hosts_agree_with_urlsplit(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in rows.select("url", urls.host_of(rows["url"]).alias("h"), urls.path_of(rows["url"]).alias("p")).collect():
        assert (r.h, r.p) == (urlsplit(r.url).netloc.lower(), urlsplit(r.url).path)


def record(i, payload, n=None, name=None):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name or i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(payload) if n is None else n}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def plain_audit(first, second):
    """Pairs all records of two files by id and occurrence."""
    def read(records):
        at, seen, out = 0, {}, {}
        for i, data in records:
            seen[i] = seen.get(i, 0) + 1
            out[i, seen[i]] = (at, data)
            at += len(data)
        return out
    one, two = read(first), read(second)
    says = lambda a, b: "missing" if b is None else "extra" if a is None else "corrupt" if a[1] != b[1] else "moved" if a[0] != b[0] else "ok"
    return sorted((f"<{k[0]}>", says(one.get(k), two.get(k))) for k in one | two)


def put(path, name, data, packed=False):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(gzip.compress(data) if packed else data)


def judged(spark, a, b):
    return warc.audit(warc.leaves(spark, str(a)), warc.leaves(spark, str(b))).collect()


def test_audit_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    good = [(i, record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(90))) + b"\xff\xfe")) for i in range(700)]
    changes = {
        "same": lambda r: r,
        "bytes": lambda r: [(i, d.replace(b"\xff\xfe", b"\xfe\xff") if i == 300 else d) for i, d in r],
        "lost": lambda r: [x for x in r if x[0] != 5],
        "lost first": lambda r: r[1:],
        "added": lambda r: [*r[:77], (9999, record(9999, b"new")), *r[77:]],
        "swapped": lambda r: [*r[:40], r[41], r[40], *r[42:]],
        "several": lambda r: [*r[10:200], *[(i, record(i, b"x")) for i in range(200, 260)], *r[261:]],
        "none": lambda r: [],
    }
    for k, change in enumerate(changes.values()):
        put(tmp_path / "one", f"{k}.warc", b"".join(d for _, d in good), packed=k % 2)
        put(tmp_path / "two", f"{k}.warc", b"".join(d for _, d in change(good)), packed=not k % 2)
    put(tmp_path / "two", "only.warc", good[0][1])
    got = judged(spark, tmp_path / "one", tmp_path / "two")
    for k, change in enumerate(changes.values()):
        assert sorted((r.record_id, r.status) for r in got if r.file == f"{k}.warc") == plain_audit(good, change(good))
    assert [(r.record_id, r.status) for r in got if r.file == "only.warc"] == [("<0>", "extra")]
    one = {(r.file, r.place): r for r in got if r.status != "extra"}
    at = 0
    for i, (_, d) in enumerate(good):
        r = one["0.warc", i]
        assert (r.offset, r.length, r.sha256, r.broken) == (at, len(d), hashlib.sha256(d).hexdigest(), False)
        at += len(d)


def test_a_lost_record_leaves_its_neighbours_alone(spark, tmp_path):
    rows = [(i, record(i, b"%d" % i * 7)) for i in range(100)]
    put(tmp_path / "one", "a", b"".join(d for _, d in rows))
    put(tmp_path / "two", "a", b"".join(d for i, d in rows if i != 5))
    says = {r.record_id: r.status for r in judged(spark, tmp_path / "one", tmp_path / "two")}
    assert says["<5>"] == "missing" and not {"corrupt", "extra"} & set(says.values()) and all(says[f"<{i}>"] == ("ok" if i < 5 else "moved") for i in range(100) if i != 5)


def test_broken_records(spark, tmp_path):
    rows = [record(i, b"payload %d" % i) for i in range(60)]
    whole = b"".join(rows)
    put(tmp_path / "one", "cut", whole)
    put(tmp_path / "two", "cut", whole[:-9])
    put(tmp_path / "one", "length", whole)
    put(tmp_path / "two", "length", b"".join([*rows[:20], record(20, b"payload 20", 9999), *rows[21:]]))
    put(tmp_path / "one", "head", whole)
    put(tmp_path / "two", "head", b"".join([*rows[:20], b"GARB" + rows[20][4:], *rows[21:]]))
    put(tmp_path / "one", "empty", b"")
    put(tmp_path / "two", "empty", b"")
    packed = gzip.compress(whole, 0)
    put(tmp_path / "one", "packed", packed)
    put(tmp_path / "two", "packed", packed[:-200])
    got = [(r.file, r.record_id, r.status) for r in judged(spark, tmp_path / "one", tmp_path / "two") if r.status not in ("ok", "moved")]
    assert ("cut", "<59>", "corrupt") in got and ("length", "<20>", "corrupt") in got and ("head", "<20>", "missing") in got and ("head", None, "extra") in got
    assert sorted(x for x in got if x[0] in ("cut", "length")) == [("cut", "<59>", "corrupt"), ("length", "<20>", "corrupt")] and ("packed", "<59>", "missing") in got
    broken = [(r.record_id, r.length) for r in warc.read_warc(spark, str(tmp_path / "two" / "cut")).where("broken").collect()]
    assert broken == [("<59>", len(rows[59]) - 9)]
    assert list(warc.records_of(b"no warc at all"))[0][5] and not list(warc.records_of(b""))


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "line\r\n\r\nnext é " * i) for i in range(30)] + [(40, None, None), (None, "http://n", "x" * 3_000_000), (5000, "http://h/5000", ""), (5000, "http://h/5000", "")]
    write = lambda df: warc.write_warc(warc.dealt(df), str(tmp_path / "w"))
    write(warc.pages_records(frame(spark, rows)))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.target, bytes(r.payload)) for r in got) == sorted((u or "", (h or "").encode()) for _, u, h in rows) and not any(r.broken for r in got)
    raw = spark.createDataFrame([(1, "a", bytearray(record(1, b"\xff\xfe\x00"))), (2, "b", None)], "page_id long, record_id string, record binary")
    warc.write_warc(warc.dealt(raw), str(tmp_path / "raw"))
    assert [bytes(r.record) for r in warc.read_warc(spark, str(tmp_path / "raw")).collect()] == [record(1, b"\xff\xfe\x00")]


def test_audit_of_small_tables(spark):
    assert warc.audit_of_damage(spark, frame(spark, [])).count() == 0
    got = warc.audit_of_damage(spark, frame(spark, [(None, None, None), (None, None, None), (1, "u", "h")])).collect()
    assert len(got) == 3 and {r.status for r in got} <= {"ok", "corrupt"}


def test_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 200_000)
    rows = [(i, f"http://a/{i}", "x" * 10_000) for i in range(40)] + [(5, "http://a/same", "y" * 1_000)] * 600 + [(9_000, "http://b", "small")]
    dealt = warc.dealt(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    sizes = {r.file: r.n for r in dealt.groupBy("file").agg(F.sum(F.octet_length("html") + 540).alias("n")).collect()}
    assert max(sizes.values()) < 260_000 and len(sizes) > 8 and sizes["2"] == 545
    judged = warc.audit_of_damage(spark, spark.createDataFrame(rows[:200], "page_id long, url string, html string"))
    assert judged.where("status = 'ok' or status = 'moved'").count() > 100


@pytest.mark.parametrize("prefix", ["", "http://"])
def test_long_urls_of_mixed_characters(spark, prefix):
    url = prefix + "x" + "a\U0001f600" * 250_000
    rows = urls.judge(spark.createDataFrame([(1, url, None), (2, url + "/y?z://", "canonical")], "page_id long, url string, html string"), urls.rules_table(spark)).orderBy("page_id").collect()
    host = "x" + "a\U0001f600" * 250_000 if prefix else ""
    assert [(r.host, r.path, r.verdict) for r in rows] == [(host, "", "allow"), (host, "/y", "allow")] if prefix else [r.host for r in rows] == ["", ""]


def test_links_relative_to_a_base(spark):
    html = '<base target="x"><base href="http://blocked.net/a/"><link rel="canonical" href="p">'
    rows = [(1, "http://ours.org/x", html), (2, "http://ours.org/y", '<base href="/deep/"><link rel="canonical" href="z">'), (3, "http://ours.org/deep/z", '<link rel="canonical" href="http://q.net/">')]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.rules_table(spark)).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block"}
