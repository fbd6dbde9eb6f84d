import pytest

from symgraph.llm import urls

CASES = [
    ('<link rel="canonical" href="page2">', "a.com/x/page2"),
    ('<link rel="canonical" href="../y?q=1#z">', "a.com/y?q=1"),
    ('<link rel="canonical" href="?id=1">', "a.com/x/page?id=1"),
    ('<link rel="canonical" href="./../../..">', "a.com/"),
    ('<link rel="canonical" href="/b/./c/../d/">', "a.com/b/d/"),
    ('<link rel="canonical" href="login?to=http://b.com/">', "a.com/x/login?to=http://b.com/"),
    ('<link rel="alternate canonical" href="https://B.com/k">', "b.com/k"),
    ("<link href=k rel='canonical alternate'>", "a.com/x/k"),
    ("<link href=/k rel=canonical>", "a.com/k"),
    ('<meta http-equiv="refresh" content="0; url=next">', "a.com/x/next"),
    ('<link rel="canonical" href="#top">', None),
    ('<link rel="canonical" href="mailto:x@y">', None),
    ('<link rel="not-canonical" href="k">', None),
    ('<link rel="alternate" href="canonical">', None),
]


@pytest.mark.parametrize("url", ["https://A.com/x/page", "https://a.com/x/page?old=1#f"])
def test_targets_are_resolved_against_the_page(spark, url):
    pages = spark.createDataFrame([(url, h) for h, _ in CASES], "url string, html string")
    node = urls.node_of
    assert pages.select(node(pages.url)).first()[0].startswith("a.com/x/page")
    got = sorted(r.v for r in urls.link_edges(pages).collect())
    assert got == sorted({v for _, v in CASES if v})


def test_relative_alias_of_a_blocked_url_is_blocked(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", '<link rel="canonical" href="bad/y">'), (2, "http://a.org", '<link rel="canonical" href="z">')], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, urls.rules_table(spark, (("a.org/bad/", "block"), ("a.org/z", "block")))).collect()}
    assert got == {1: "block", 2: "block"}
