"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.operators import search
from symgraph.plans import adapters as A
from symgraph.plans.adapters import DECLARES, FILES, REFS, SYMBOLS, with_ctes
from symgraph.registry import query

ASKED = ("red bolt", "NATION_1", "cold", "Supplier#00000001", "bolt", "global::ASIA.NATION_2", "xyzzy gear", "re")
ASKED_SQL = "asked(query) AS (VALUES " + ", ".join(f"('{w}')" for w in ASKED) + ")"


def asked(spark, *words):
    return spark.createDataFrame([(w,) for w in words or ASKED], "query string")


GRAMS = """searched AS (SELECT * FROM symbols WHERE kind IN ('Type', 'Method', 'Property', 'Field')),
prefix AS (SELECT query, id FROM searched JOIN asked ON starts_with(lower(name), lower(query))),
qgrams AS (SELECT query, unnest(CASE WHEN length(query) < 3 THEN [lower(query)] ELSE list_transform(range(1, length(query) - 1), lambda i: substr(lower(query), i, 3)) END) AS gram FROM asked),
qg AS (SELECT query, gram, count(*) AS times FROM qgrams GROUP BY 1, 2), qn AS (SELECT query, sum(times) AS grams FROM qg GROUP BY 1),
sg AS (SELECT DISTINCT id, full_name, unnest(CASE WHEN length(name) < 3 THEN [lower(name)] ELSE list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3)) END) AS gram FROM searched),
shared_grams AS (SELECT query, id, full_name, sum(times)::bigint AS overlap FROM sg JOIN qg USING (gram) GROUP BY 1, 2, 3),
fuzzy AS (SELECT query, id, overlap, round(0.3::double + 0.4::double * overlap / grams, 9) AS graded FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, full_name, id) AS n FROM shared_grams) JOIN qn USING (query) WHERE n <= 20)"""
TIERS = """tiers AS (SELECT query, id, 1.0::double AS score, 'exact_full' AS match FROM symbols JOIN asked ON full_name = query UNION ALL SELECT query, id, 0.9, 'exact_name' FROM symbols JOIN asked ON name = query UNION ALL SELECT query, id, 0.7, 'prefix' FROM prefix),
opened AS (SELECT query FROM asked WHERE query NOT IN (SELECT query FROM tiers GROUP BY query HAVING count(DISTINCT id) >= 5)),
best AS (SELECT query, id, max(score) AS score, max_by(match, score) AS match FROM (FROM tiers UNION ALL SELECT query, id, 0.4, 'fuzzy' FROM fuzzy WHERE query IN (SELECT query FROM opened)) GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT b.query, b.id, s.name, s.full_name, s.kind, s.repository, b.score, b.match, row_number() OVER (PARTITION BY b.query ORDER BY b.score DESC, s.full_name, b.id) AS place FROM best b JOIN symbols s ON s.id = b.id))"""


@query(with_ctes("SELECT query, id FROM prefix", SYMBOLS, ASKED_SQL, GRAMS))
def find_symbol_prefix(spark, d):
    return search.by_prefix(A.symbols(spark, d), asked(spark)).select("query", "id")


@query(with_ctes("SELECT query, id, overlap, graded FROM fuzzy", SYMBOLS, ASKED_SQL, GRAMS))
def find_symbol_fuzzy_trigram(spark, d):
    return search.by_trigrams(A.symbols(spark, d), asked(spark)).withColumn("graded", F.round("graded", 9))


@query(with_ctes("SELECT query, id, score, match FROM found WHERE query = 'red bolt' AND place <= 50", SYMBOLS, ASKED_SQL, GRAMS, TIERS))
def find_symbol_tiers(spark, d):
    return search.find_symbols(A.symbols(spark, d), asked(spark, "red bolt")).select("query", "id", "score", "match")


@query(with_ctes("SELECT query, id, score, match FROM found WHERE place <= 50", SYMBOLS, ASKED_SQL, GRAMS, TIERS))
def find_symbol_batch(spark, d):
    return search.find_symbols(A.symbols(spark, d), asked(spark)).select("query", "id", "score", "match")


@query(with_ctes("SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, full_name, id) AS k FROM found WHERE kind = 'Method') WHERE k <= 10", SYMBOLS, ASKED_SQL, GRAMS, TIERS))
def find_symbol_kind(spark, d):
    return search.find_symbols(A.symbols(spark, d), asked(spark), 10, kind="Method").select("query", "id", "score")


ACROSS = """filled AS (SELECT t.query, s.repository FROM tiers t JOIN symbols s USING (id) GROUP BY 1, 2 HAVING count(DISTINCT t.id) >= 5),
fuzzy_r AS (SELECT query, repository, id FROM (SELECT o.query, s.repository, o.id, row_number() OVER (PARTITION BY o.query, s.repository ORDER BY overlap DESC, o.full_name, o.id) AS n FROM shared_grams o JOIN symbols s ON s.id = o.id) WHERE n <= 20 AND (query, repository) NOT IN (FROM filled)),
best_r AS (SELECT query, repository, id, max(score) AS score FROM (SELECT t.query, s.repository, t.id, score FROM tiers t JOIN symbols s USING (id) UNION ALL SELECT query, repository, id, 0.4 FROM fuzzy_r) GROUP BY 1, 2, 3),
found_r AS (SELECT * FROM (SELECT b.*, s.full_name, row_number() OVER (PARTITION BY query, b.repository ORDER BY score DESC, s.full_name, b.id) AS k FROM best_r b JOIN symbols s USING (id)) WHERE k <= 50)"""


@query(with_ctes("SELECT query, repository, id, score FROM (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY score DESC, repository, full_name, id) AS place FROM found_r f) WHERE place <= 20", SYMBOLS, ASKED_SQL, GRAMS, TIERS, ACROSS))
def cross_repo_search(spark, d):
    return search.find_across(A.symbols(spark, d), asked(spark)).select("query", "repository", "id", "score")


TEXT = """lines AS (SELECT file_path, unnest(string_split_regex(content, '\\r?\\n')) AS text, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line FROM files WHERE content IS NOT NULL),
hits AS (SELECT query, file_path, line::int AS line, trim(text) AS content, CASE WHEN starts_with(lower(text), lower(query)) THEN 1.0 ELSE 0.8 END::double AS score FROM lines JOIN asked ON contains(lower(text), lower(query)))"""


@query(with_ctes("SELECT file_path, line, score, content FROM hits", FILES, "asked(query) AS (VALUES ('the'))", TEXT))
def source_text_search(spark, d):
    return search.source_text(A.files(spark, d), asked(spark, "the"), None, index=A.text_index(spark, d)).select("file_path", "line", "score", "content")


@query(with_ctes("SELECT query, file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_path, line) AS n FROM hits) WHERE n <= 20", FILES, "asked(query) AS (VALUES ('the'), ('und'), ('trash'), ('que '), ('q'))", TEXT))
def source_text_topk(spark, d):
    return search.source_text(A.files(spark, d), asked(spark, "the", "und", "trash", "que ", "q", " "), index=A.text_index(spark, d)).select("query", "file_path", "line")


@query(
    with_ctes(
        """SELECT query, 'symbol' AS source, full_name AS place, score FROM found WHERE place <= 20 UNION ALL
SELECT query, 'text', file_path || ':' || line, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_path, line) AS n FROM hits) WHERE n <= 20""",
        SYMBOLS, FILES, ASKED_SQL, GRAMS, TIERS, TEXT,
    )
)
def search_code(spark, d):
    return search.search_code(A.symbols(spark, d), A.files(spark, d), asked(spark), index=A.text_index(spark, d))


@query(with_ctes("SELECT file_path, line, kind FROM refs WHERE symbol_id = 17", REFS))
def references_of(spark, d):
    from symgraph.operators.tables import references_of as of

    return of(A.refs(spark, d), 17).select("file_path", "line", "kind")


@query(with_ctes("SELECT symbol_id, kind, round(sum(CASE kind WHEN 'Call' THEN 1.0 WHEN 'Read' THEN 0.6 ELSE 0.8 END), 6)::double AS score FROM refs GROUP BY 1, 2", REFS))
def reference_relevance(spark, d):
    return search.reference_relevance(A.refs(spark, d)).groupBy("symbol_id", "kind").agg(F.round(F.sum("score"), 6).alias("score"))


#: Queries of several words, and the terms that they hold, which are searched for by themselves.
HYBRID = {"red bolt": ("red", "bolt"), "NATION_1": ("NATION_1",), "What is the Supplier#00000001?": ("Supplier#00000001",), "cold gear of NATION_2, xyzzy": ("cold", "gear", "NATION_2", "xyzzy"), "re": ()}
HYBRID_SQL = ", ".join([
    "asked(query) AS (VALUES " + ", ".join(f"('{w}')" for w in sorted({*HYBRID, *(t for ts in HYBRID.values() for t in ts)})) + ")", "by_term(query, term) AS (VALUES " + ", ".join(f"('{q}', '{t}')" for q, ts in HYBRID.items() for t in ts) + ")",
    "whole(query) AS (VALUES " + ", ".join(f"('{q}')" for q in HYBRID) + ")",
])
NEAR = """seeds AS (SELECT DISTINCT b.query, f.id AS seed FROM by_term b JOIN found f ON f.query = b.term AND f.place <= 5),
ways AS (SELECT source_id AS src, target_id AS dst FROM declares UNION SELECT target_id, source_id FROM declares),
one AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN ways ON src = seed), two AS (SELECT DISTINCT seed, dst AS node FROM one JOIN ways ON src = node),
steps AS (SELECT seed, node, 1 AS depth FROM one UNION ALL SELECT seed, node, 2 FROM two WHERE (seed, node) NOT IN (FROM one)),
hood AS (SELECT seed, node, 1.0::double / (1 + depth) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM steps WHERE node != seed) WHERE n <= 50),
near AS (SELECT query, node AS id, max(score) AS g FROM hood JOIN seeds USING (seed) WHERE node IN (SELECT id FROM symbols) GROUP BY 1, 2),
ranks AS (SELECT query, id, 1.0::double / (60 + place) AS f FROM found WHERE place <= 30 AND query IN (FROM whole))"""


@query(
    with_ctes(
        """SELECT query, id, round(f + 0.5 * g, 9) AS score, round(f, 9) AS fuzzy_score, round(g, 9) AS graph_score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY f + 0.5 * g DESC, id) AS n FROM (
SELECT query, id, coalesce(f, 0) AS f, coalesce(g, 0) AS g FROM ranks FULL JOIN near USING (query, id))) WHERE n <= 10""",
        SYMBOLS, DECLARES, HYBRID_SQL, GRAMS, TIERS, NEAR,
    )
)
def hybrid_rrf(spark, d):
    rows = search.hybrid(A.symbols(spark, d), A.declares(spark, d), asked(spark, *HYBRID))
    return rows.select("query", "id", *[F.round(c, 9).alias(c) for c in ("score", "fuzzy_score", "graph_score")])


@query("SELECT source || '/' || doc_id AS file_path, 2 AS line, array_to_string(list_slice(string_split(text, chr(10)), 1, 4), chr(10)) AS snippet FROM documents")
def reference_snippets(spark, d):
    f = A.files(spark, d)
    return search.snippets(f, f.select("file_path", F.lit(2).alias("line")))
