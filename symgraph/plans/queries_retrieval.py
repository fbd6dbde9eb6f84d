"""Retrieval, chunk and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.functions.text import CONTEXT_STOP_WORDS, STOP_WORDS
from symgraph.operators import retrieval, vector_index
from symgraph.plans import adapters as A
from symgraph.plans.adapters import CALLS, FILES, NODES, SYMBOLS, with_ctes
from symgraph.plans.queries_search import GRAMS, TIERS
from symgraph.registry import query
from symgraph.session import materialise, table


def _terms(source: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    kept = f"list_filter(list_transform(list_filter(string_split({source}, ' '), lambda w: length(w) > 2 AND NOT list_contains([{words}], lower(w))), lambda w: trim(w, '.,?!')), lambda w: w != '')"
    return kept


@query(f"SELECT conv_id, turn, unnest({_terms('text', STOP_WORDS)}) AS term, generate_subscripts({_terms('text', STOP_WORDS)}, 1)::int - 1 AS place FROM conversations WHERE role = 'user'")
def extract_terms(spark, d):
    from symgraph.functions.text import terms

    return A.questions(spark, d).select("conv_id", "turn", F.posexplode(terms(F.col("question"))).alias("place", "term"))


QUESTIONS = ("How does Supplier#000000003 use the red bolt?", "What is NATION_1 and where is cold gear", "why, xyzzy!")
QUESTIONS_SQL = "questions(question) AS (VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ")"


def _questions(spark):
    return spark.createDataFrame([(q,) for q in QUESTIONS], "question string")


#: Calls among symbols: a supplier calls the parts of its order lines.
SOLD = "calls AS (SELECT DISTINCT s.id AS source_id, md5('part:' || l_partkey::varchar) AS target_id FROM lineitem JOIN symbols s ON s.name = 'Supplier#' || lpad(l_suppkey::varchar, 9, '0'))"


@A.stored
def _sold(spark, d):
    """Calls of suppliers to parts."""
    s = A.symbols(spark, d).where("kind = 'Method'").select("id", "name").distinct()
    line = table(spark, d, "lineitem").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("name"), "l_partkey")
    line = line.repartition("name").distinct()  # dealt once, as the join wants it; an id has one name, so what comes out is distinct
    return line.join(s, "name").select(F.col("id").alias("source_id"), ids.node_id(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("target_id"), F.lit("Calls").alias("kind"))


TERMS_SQL = f"terms AS (SELECT question, unnest({_terms('question', STOP_WORDS)}) AS term, generate_subscripts({_terms('question', STOP_WORDS)}, 1) AS place FROM questions)"
EVIDENCE = f"""{TERMS_SQL}, asked AS (SELECT DISTINCT term AS query FROM terms), {GRAMS}, {TIERS},
first AS (SELECT question, id, max(score) AS score FROM found JOIN terms ON term = query WHERE found.place <= 5 GROUP BY 1, 2),
up1 AS (SELECT DISTINCT f.id AS seed, source_id AS node FROM first f JOIN calls ON target_id = f.id), up2 AS (SELECT DISTINCT seed, source_id AS node FROM up1 JOIN calls ON target_id = node),
dn1 AS (SELECT DISTINCT f.id AS seed, target_id AS node FROM first f JOIN calls ON source_id = f.id), dn2 AS (SELECT DISTINCT seed, target_id AS node FROM dn1 JOIN calls ON source_id = node),
ways AS (SELECT seed, node, 0.8::double AS score, 1 AS o, 'caller' AS source FROM up1 UNION ALL SELECT seed, node, 0.5, 1, 'caller' FROM up2 WHERE (seed, node) NOT IN (FROM up1)
 UNION ALL SELECT seed, node, 0.8, 2, 'callee' FROM dn1 UNION ALL SELECT seed, node, 0.5, 2, 'callee' FROM dn2 WHERE (seed, node) NOT IN (FROM dn1)),
seen AS (SELECT question, id, score, 0 AS o, 'symbol_search' AS source FROM first UNION ALL SELECT question, node, max(w.score), o, source FROM ways w JOIN first f ON f.id = seed WHERE node IN (SELECT id FROM symbols) GROUP BY question, node, o, source),
once AS (SELECT question, id, arg_min(score, o) AS score, arg_min(source, o) AS source FROM seen GROUP BY 1, 2),
evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS place FROM once) WHERE place <= 30)"""


def _evidence(spark, d):
    return retrieval.evidence(A.symbols(spark, d), _sold(spark, d), _questions(spark))


@query(with_ctes("SELECT question, id, source, score, place::int AS place FROM evidence", SYMBOLS, QUESTIONS_SQL, SOLD, EVIDENCE))
def rag_evidence(spark, d):
    return _evidence(spark, d).select("question", "id", "source", "score", "place")


PROMPT = """shown AS (SELECT e.question, '### ' || s.full_name || chr(10) || '- Kind: ' || s.kind || chr(10) || '- File: :0' || chr(10) || chr(10) AS t, row_number() OVER (PARTITION BY e.question ORDER BY place) AS n FROM evidence e JOIN symbols s USING (id) WHERE source = 'symbol_search'),
links AS (SELECT question, a.full_name AS f, b.full_name AS t, min(place) AS place FROM evidence e JOIN calls ON source_id = e.id JOIN symbols a ON a.id = source_id JOIN nodes b ON b.id = target_id GROUP BY 1, 2, 3),
links20 AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY place, f, t) AS n FROM links),
prompts AS (SELECT question, 'You are a C# code expert. Answer based on the following code context.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || '## Relevant Code Symbols' || chr(10) || coalesce((SELECT string_agg(t, '' ORDER BY n) FROM shown s WHERE s.question = q.question AND n <= 10), '')
 || '## Code Relationships' || chr(10) || coalesce((SELECT string_agg('- ' || f || ' → ' || t || ': Calls' || chr(10), '' ORDER BY n) FROM links20 l WHERE l.question = q.question AND n <= 20), '') || chr(10) || 'Provide a comprehensive answer explaining how the code works.' || chr(10) AS prompt FROM (SELECT DISTINCT question FROM evidence) q)"""


@query(with_ctes("SELECT question, prompt, length(prompt) // 4 AS tokens FROM prompts", SYMBOLS, NODES, QUESTIONS_SQL, SOLD, EVIDENCE, PROMPT))
def rag_prompt(spark, d):
    from symgraph.operators.graph import relationships

    s = A.symbols(spark, d)
    found = _evidence(spark, d)
    return retrieval.prompts(found, s, relationships(s, A.nodes(spark, d), _sold(spark, d), found.select("id")))


@query("SELECT conv_id, turn, length(text) // 4 AS tokens, CASE WHEN contains(lower(text), 'who calls') OR contains(lower(text), 'caller') THEN 'Callers' WHEN contains(lower(text), 'implement') THEN 'Implementations' WHEN contains(lower(text), 'inherit') OR contains(lower(text), 'derive') THEN 'Hierarchy' WHEN contains(lower(text), 'impact') OR contains(lower(text), 'affect') OR contains(lower(text), 'break') THEN 'Impact' WHEN contains(lower(text), 'how') THEN 'Explain' ELSE 'Search' END AS intent FROM conversations WHERE role = 'user'")
def rag_tokens(spark, d):
    from symgraph.functions.text import prompt_tokens

    return A.questions(spark, d).select("conv_id", "turn", prompt_tokens(F.col("question")).alias("tokens"), retrieval.intent(F.col("question")).alias("intent"))


CONTEXT = f"""terms AS (SELECT question, unnest({_terms('question', CONTEXT_STOP_WORDS)}) AS term, generate_subscripts({_terms('question', CONTEXT_STOP_WORDS)}, 1) AS p FROM questions), asked AS (SELECT DISTINCT term AS query FROM terms), {GRAMS}, {TIERS},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY first, score DESC, id) AS place FROM (SELECT question, id, max_by(score, p) AS score, min(p) AS first FROM found JOIN terms ON term = query WHERE place <= 5 GROUP BY 1, 2)) WHERE place <= 20),
sides AS (SELECT seed, node AS f, seed AS t FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS n FROM (SELECT DISTINCT c.id AS seed, source_id AS node FROM chosen c JOIN calls ON target_id = c.id)) WHERE n <= 5
 UNION ALL SELECT seed, seed, node FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS n FROM (SELECT DISTINCT c.id AS seed, target_id AS node FROM chosen c JOIN calls ON source_id = c.id)) WHERE n <= 5),
links AS (SELECT DISTINCT question, f AS from_id, t AS to_id FROM sides JOIN chosen ON chosen.id = seed)"""


@query(with_ctes("SELECT question, id, score, place::int AS place FROM chosen", SYMBOLS, QUESTIONS_SQL, SOLD, CONTEXT))
def build_context(spark, d):
    return retrieval.context(A.symbols(spark, d), _sold(spark, d), _questions(spark))[0].select("question", "id", "score", "place")


@query(with_ctes("SELECT question, from_id, to_id FROM links", SYMBOLS, QUESTIONS_SQL, SOLD, CONTEXT))
def context_relationships(spark, d):
    return retrieval.context(A.symbols(spark, d), _sold(spark, d), _questions(spark))[1].select("question", "from_id", "to_id")


@query(
    with_ctes(
        """SELECT question, 'You are a C# code expert. Answer based on the provided context.' || n || n || 'Question: ' || question || n || n || CASE WHEN s IS NULL THEN '' ELSE '## Relevant Symbols' || n || s END
 || CASE WHEN l IS NULL THEN '' ELSE '## Relationships' || n || l || n END || 'Provide a comprehensive answer based on the above context.' || n AS prompt FROM (SELECT question, chr(10) AS n,
(SELECT string_agg('- **' || full_name || '** (' || kind || ')' || chr(10) || '  File: :0' || chr(10) || chr(10), '' ORDER BY place) FROM chosen JOIN symbols USING (id) WHERE chosen.question = q.question) AS s,
(SELECT string_agg('- ' || f || ' → ' || t || ': Calls' || chr(10), '' ORDER BY f, t) FROM (SELECT a.full_name AS f, b.full_name AS t, row_number() OVER (ORDER BY a.full_name, b.full_name) AS k FROM links JOIN symbols a ON a.id = from_id JOIN symbols b ON b.id = to_id WHERE links.question = q.question) WHERE k <= 20) AS l FROM questions q)""",
        SYMBOLS, QUESTIONS_SQL, SOLD, CONTEXT,
    )
)
def context_prompt(spark, d):
    s = A.symbols(spark, d)
    chosen, links = retrieval.context(s, _sold(spark, d), _questions(spark))
    return retrieval.context_prompts(_questions(spark), chosen, links, s)


@query(
    with_ctes(
        """SELECT question, symbols, relations, length(question) // 4 + 50 * symbols + 20 * relations AS tokens, round(conf, 9) AS confidence, conf > 0.65 AS sufficient FROM (SELECT *, CASE WHEN symbols = 0 THEN 0.0::double ELSE least(1.0::double, 0.6::double * best + 0.3::double * least(1.0::double, relations / 10.0::double) + CASE WHEN symbols >= 3 THEN 0.1::double ELSE 0.0::double END) END AS conf
FROM (SELECT question, (SELECT count(*) FROM chosen c WHERE c.question = q.question) AS symbols, (SELECT count(*) FROM links l WHERE l.question = q.question) AS relations, coalesce((SELECT max(score) FROM chosen c WHERE c.question = q.question), 0) AS best FROM questions q))""",
        SYMBOLS, QUESTIONS_SQL, SOLD, CONTEXT,
    )
)
def context_confidence(spark, d):
    chosen, links = retrieval.context(A.symbols(spark, d), _sold(spark, d), _questions(spark))
    return retrieval.context_summary(_questions(spark), chosen, links).withColumn("confidence", F.round("confidence", 9))


@query("SELECT source, doc_id, total::bigint AS total FROM (SELECT source, doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 8000")
def context_budget(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.expr("length(text) div 4").alias("tokens"))
    return retrieval.within_budget(rows, 8000, ["source"], ["doc_id"]).select("source", "doc_id", "total")


CHUNKS = """parts AS (SELECT file_path, string_split(content, chr(10)) AS lines FROM files), starts AS (SELECT file_path, lines, unnest(range(0, len(lines), 100)) AS skip FROM parts),
chunks AS (SELECT file_path, (skip + 1)::int AS start_line, least(skip + 100, len(lines))::int AS end_line, array_to_string(list_slice(lines, skip + 1, skip + 100), chr(10)) AS content FROM starts)"""


@query(with_ctes("SELECT file_path, start_line, end_line, to_base64(unhex(md5(content))) AS content_hash, ceil(length(content) / 3.0::double)::bigint AS tokens FROM chunks", FILES, CHUNKS))
def chunk_lines(spark, d):
    return retrieval.chunk_lines(A.files(spark, d)).drop("content")


CHUNK_SYMBOLS = """marks AS (SELECT file_path, string_split(content, chr(10)) AS lines, (doc_id % 5)::int AS a, (doc_id % 5 + doc_id % 3)::int AS b FROM files),
cut AS (SELECT file_path, a + 1 AS start_line, least(b, len(lines) - 1)::int + 1 AS end_line, array_to_string(list_slice(lines, a + 1, least(b, len(lines) - 1) + 1), chr(10)) AS content FROM marks WHERE a < len(lines) AND least(b, len(lines) - 1) >= a)"""


def _doc_symbols(spark, d):
    a = F.col("doc_id") % 5
    return A.files(spark, d).select(F.col("file_path").alias("id"), F.col("file_path").alias("name"), F.concat(F.lit("global::"), "file_path").alias("full_name"), "file_path", a.cast("int").alias("start_line"), (a + F.col("doc_id") % 3).cast("int").alias("end_line"), F.lit("Method").alias("kind"))


@query(with_ctes("SELECT file_path, start_line, end_line, to_base64(unhex(md5(content))) AS content_hash, ceil(length(content) / 3.0::double)::bigint AS tokens FROM cut", FILES, CHUNK_SYMBOLS))
def chunk_symbol(spark, d):
    return retrieval.chunk_symbols(_doc_symbols(spark, d), A.files(spark, d)).select("file_path", "start_line", "end_line", "content_hash", "tokens")


@query(
    with_ctes(
        """SELECT c.file_path AS id, md5('// Symbol: global::' || c.file_path || chr(10) || CASE WHEN names IS NULL THEN '' ELSE '// Related: ' || array_to_string(list_slice(names, 1, 5), ', ') || chr(10) END || chr(10) || content) AS hash, coalesce(array_to_string(names, ','), '') AS related
FROM cut c LEFT JOIN (SELECT source || '/' || doc_id AS file_path, list(l ORDER BY l) AS names FROM (SELECT source, doc_id, unnest(range(0, doc_id % 8))::varchar AS l FROM documents) GROUP BY 1) r USING (file_path)""",
        FILES, CHUNK_SYMBOLS,
    )
)
def chunk_graph_context(spark, d):
    f = A.files(spark, d)
    related = f.where("doc_id % 8 > 0").select(F.col("file_path").alias("id"), F.posexplode(F.sequence(F.lit(0), (F.col("doc_id") % 8 - 1).cast("int"))).alias("place", "n")).select("id", "place", F.col("n").cast("string").alias("related"))
    rows = retrieval.chunk_with_context(retrieval.chunk_symbols(_doc_symbols(spark, d), f), related)
    return rows.select("id", F.md5("content").alias("hash"), "related")


COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))"
NORM = lambda t: f"sqrt(list_sum(list_transform({t}.embedding, lambda x: x::double * x::double)))"


def _targets(spark, d):
    """Every fiftieth vector as a query."""
    v = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return v.select(F.col("vec_id").alias("query"), F.lit("all").alias("collection"), F.col("embedding").alias("target"))


def _top(score: str, where: str = "true") -> str:
    return f"SELECT query, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM (SELECT b.vec_id AS query, a.vec_id AS id, {score} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND {where})) WHERE n <= 10"


@query(_top(f"{COSINE} / ({NORM('a')} * {NORM('b')})"))
def vector_topk(spark, d):
    return retrieval.vector_search(A.vectors(spark, d), _targets(spark, d)).select("query", "id", F.round("score", 5).alias("score"))


@query(_top(COSINE, f"a.label NOT IN (2, 5) AND {COSINE} >= 0"))
def vector_filtered(spark, d):
    keep = ~F.try_element_at("payload", F.lit("label")).isin("2", "5")
    return retrieval.vector_search(A.vectors(spark, d), _targets(spark, d), where=keep, measure="dot", least=0.0).select("query", "id", F.round("score", 5).alias("score"))


@query(_top("0.0::double - sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))))"))
def vector_euclidean(spark, d):
    return retrieval.vector_search(A.vectors(spark, d), _targets(spark, d), measure="euclidean").select("query", "id", F.round("score", 5).alias("score"))


@query()
def vector_index_topk(spark, d):
    """The same queries by inverted lists; tests hold their recall against the exact way."""
    v = A.vectors(spark, d)
    centres = vector_index.train(v)
    index = materialise(vector_index.listed(v.select("collection", "id", "vector"), centres), "vector-index")
    return vector_index.search(index, centres, _targets(spark, d)).select("query", "id", F.round("score", 5).alias("score"))


@query("SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 30")
def vector_scroll(spark, d):
    return retrieval.scroll(A.vectors(spark, d), "all", 20, 30).select("id")


@query("SELECT vec_id AS id, label + CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END AS label FROM embeddings WHERE vec_id % 5 != 0")
def vector_upsert_delete(spark, d):
    v = A.vectors(spark, d)
    new = v.where("id % 4 = 0").withColumn("payload", F.create_map(F.lit("label"), (F.col("payload")["label"].cast("int") + 100).cast("string")))
    rows = retrieval.delete_vectors(retrieval.upsert_vectors(v, new), v.where("id % 5 = 0").select("collection", "id"))
    return rows.select("id", F.col("payload")["label"].cast("int").alias("label"))


@query("SELECT source || '/' || doc_id AS file_path, to_base64(unhex(md5(text))) AS content_hash FROM documents WHERE length(text) % 3 != 0")
def embedding_cache_miss(spark, d):
    f = A.files(spark, d).withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("model", F.lit("m"))
    cache = f.where(F.length("content") % 3 == 0).select("content_hash", "model").distinct()
    missing = retrieval.cache_misses(f, cache).select("content_hash")
    return f.join(missing, "content_hash", "left_semi").select("file_path", "content_hash")


@query("SELECT part, batch, count(*) AS n FROM (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY h) - 1) // 32 AS batch FROM (SELECT DISTINCT to_base64(unhex(md5(text))) AS h, substr(md5(to_base64(unhex(md5(text)))), 1, 2) AS part FROM documents)) GROUP BY 1, 2")
def embedding_batches(spark, d):
    rows = A.files(spark, d).select(ids.text_hash(F.col("content")).alias("content_hash")).distinct()
    return retrieval.batched(rows).groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source || '/' || doc_id AS file_path, to_base64(unhex(md5(text))) AS content_hash, 64 AS size FROM documents")
def embed_documents(spark, d):
    f = A.files(spark, d).select("file_path", F.lit(0).alias("chunk_index"), "content")
    cache = spark.createDataFrame([], "content_hash string, model string, vector array<float>")
    return retrieval.embed(f, cache, "nomic-embed-text").select("file_path", "content_hash", F.size("vector").alias("size"))
