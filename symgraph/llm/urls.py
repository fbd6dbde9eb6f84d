"""URL filters with redirect equivalence.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts with the rule's, and the
longest wins. Urls that redirects or canonical links connect are aliases: a block of one blocks those without a rule of
their own, unless an alias is explicitly allowed, which takes precedence.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.components import components
from symgraph.session import broadcast_if, materialise

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BROADCAST_ROWS = 500_000
#: Rules that are put into the plan as a map; more are joined.
RULES_IN_PLAN = 2_000


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, number sign or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one resource share: host, path and query. Null without a host."""
    query = F.coalesce(F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path and others) with rule and said (allow or block) of the longest rule that fits, else null.

    rules has host, path, verdict; a rule with a null in any of them, and an empty table, fit nothing. Of rules of one
    length allow wins, be they equal or not; repeated rules count once. Each host is looked up by its suffixes of whole
    labels, so the work does not grow with the number of rules.
    """
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_said")).dropna().distinct()
    few = known.limit(RULES_IN_PLAN + 1).collect()
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    if len(few) <= RULES_IN_PLAN:
        by: dict[str, list] = {}
        for r in few:
            by.setdefault(r["rule_host"], []).append((len(r["rule_host"] + r["rule_path"]), r["rule_path"], r["rule_said"], r["rule_host"] + r["rule_path"]))
        if not by:
            return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("said", F.lit(None).cast("string"))
        one = lambda x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("n", "p", "said", "rule"), x, strict=True)])
        lookup = F.create_map(*[c for h, xs in sorted(by.items()) for c in (F.lit(h), F.array(*map(one, xs)))])
        hits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(lookup, s)), lambda a: a.isNotNull()))
        fits = F.filter(hits, lambda r: F.startswith(F.col("path"), r["p"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), (r["said"] == "allow").alias("allow"), r["rule"].alias("rule"), r["said"].alias("said"))))
        return rows.withColumn("best", best).select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))
    places = rows.select("host", "path").distinct()
    hits = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(broadcast_if(known, BROADCAST_ROWS), "rule_host").where(F.startswith("path", "rule_path"))
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("rule_said") == "allow").alias("allow"), text.alias("rule"), F.col("rule_said").alias("said"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))


def without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments; .. at the top gives nothing."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    empty = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, empty, step), last), "/"))


def resolved(to: Column, url: Column) -> Column:
    """A link's target as a whole url: with a scheme as it is; else relative to the page's url. Null for schemes without //."""
    site, path = F.concat(F.regexp_extract(url, r"^([^:/?#]*://)", 1), host_of(url)), path_of(url)
    own, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("/")), F.concat(site, without_dots(own), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(site, path, rest))
        .when(F.startswith(to, F.lit("#")), F.concat(site, path, query))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """u, v: nodes that a canonical link or a refresh in the page's html connects with the page's own url.

    Targets may be absolute or relative to the page's first base tag, itself relative to the page's url, or without one to
    that; canonical may stand anywhere in rel. Html without such a tag gives nothing.
    """
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "").alias("html"))
    base = F.replace(F.regexp_extract("html", r"""(?i)<base\b[^>]*?\shref\s*=\s*["']?([^"'\s>]+)""", 1), F.lit("&amp;"), F.lit("&"))
    some = some.withColumn("base", F.when(base != "", resolved(base, F.col("url"))))
    tags = some.select("url", "base", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?i)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical[\s/>])"""), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(F.col("tag").rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    found = tags.select("url", "base", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).where("to != ''")
    whole = resolved(F.col("to"), F.coalesce("base", "url"))
    return found.select(node_of(F.col("url")).alias("u"), node_of(whole).alias("v")).where("u is not null and v is not null and u != v").distinct()


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    edges (u, v of node_of) are redirects known from elsewhere, beside those in the html. A page with a rule has the
    rule's verdict. One without has block if its component holds a blocked url and no allowed one, else allow; urls that
    are only link targets count too. Null urls and those without :// have empty host and path, no rule, no alias, and
    are allowed. Repeated rows give repeated results; null html links nothing; very long urls are cut in one pass, without
    recursion; an empty table gives an empty result.
    """
    found = link_edges(pages)
    found = materialise(found if edges is None else found.unionByName(edges.select("u", "v")).distinct(), "url-edges")
    rows = ruled(pages.select("page_id", F.col("url").alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if found.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    parts = components(found)
    place = F.concat(F.lit("x://"), F.col("node"))
    said = ruled(parts.select("node", "root", host_of(place).alias("host"), path_of(place).alias("path")), rules)
    verdicts = said.groupBy("root").agg(F.coalesce(F.max(F.col("said") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.max(F.col("said") == "block"), F.lit(False)).alias("blocked"))
    aliases = materialise(said.join(verdicts.where("blocked and not allowed"), "root").select("node"), "url-blocked")
    rows = rows.withColumn("node", node_of(F.col("url"))).join(broadcast_if(aliases.withColumn("by_alias", F.lit("block")), BROADCAST_ROWS), "node", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", "by_alias", F.lit("allow")).alias("verdict"))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """host, path, verdict of rules written like example.net/en/."""
    rows = [(t[: t.index("/")], t[t.index("/") :], v) for t, v in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


#: For DuckDB: rules by join, aliases by a recursive walk from the blocked and allowed urls.
ORACLE = r"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
p AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1), '') AS query FROM p),
tags AS (SELECT host, host || path || query AS u, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM h WHERE host != '' AND regexp_matches(html, '(?i)canonical|http-equiv')),
tos AS (SELECT host, u, replace(CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
 WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS t FROM tags),
ends AS (SELECT u, CASE WHEN contains(t, '://') THEN substr(t, instr(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) WHEN starts_with(t, '/') THEN host || t END AS r FROM tos),
links AS (SELECT DISTINCT u, lower(regexp_extract(r, '^[^/?#]*')) || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS v FROM ends WHERE r IS NOT NULL),
pairs AS (SELECT u, v FROM links WHERE u != v UNION SELECT v, u FROM links WHERE u != v),
nodes AS (SELECT DISTINCT u AS node, regexp_extract(u, '^[^/?#]*') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM pairs),
said AS (SELECT node, max_by(v, length(rh || rp)) AS v FROM nodes JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node),
reach(node, v) AS (SELECT node, v FROM said UNION SELECT b.v, r.v FROM reach r JOIN pairs b ON b.u = r.node),
alias AS (SELECT node FROM reach GROUP BY node HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow')),
own AS (SELECT h.page_id, h.url, h.host, h.path, h.query, max_by(rh || rp, length(rh || rp)) AS rule, max_by(r.v, length(rh || rp)) AS v
 FROM h LEFT JOIN rules r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.v, CASE WHEN a.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM own o LEFT JOIN alias a ON o.host != '' AND a.node = o.host || o.path || o.query
"""
