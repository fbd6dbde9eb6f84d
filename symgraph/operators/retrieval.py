"""Graph RAG, context building, chunks, embeddings and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.functions.text import CONTEXT_STOP_WORDS, chunk_tokens, cosine, dot, euclidean, prompt_tokens, terms
from symgraph.operators import graph, search, tables
from symgraph.session import broadcast_if, materialise


def asked_terms(questions: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Question, place, term."""
    found = terms(F.col("question")) if stop is None else terms(F.col("question"), stop)
    return questions.select("question", F.posexplode(found).alias("place", "term"))


def evidence(symbols: DataFrame, edges: DataFrame, questions: DataFrame, most: int = 30, a_term: int = 5, depth: int = 2) -> DataFrame:
    """Question, id, source, score; a symbol once, from where it is seen first.

    Symbols found by the question's terms come first, then those that call them, then those they call; 0.8 at one step,
    0.5 beyond."""
    by_term = asked_terms(questions)
    hits = search.find_symbols(symbols, by_term.select(F.col("term").alias("query")), a_term).withColumnRenamed("query", "term")
    first = hits.join(by_term, "term").groupBy("question", "id").agg(F.max("score").alias("score")).withColumn("source", F.lit("symbol_search")).withColumn("order", F.lit(0))
    first = materialise(first, "evidence")  # a few symbols a term; used three times
    seeds = first.select(F.col("id").alias("seed")).distinct()
    nodes = symbols.select("id")
    step = lambda df, source, order: df.join(first.select("question", F.col("id").alias("seed")), "seed").groupBy("question", F.col("node").alias("id")).agg(F.max(F.when(F.col("depth") == 1, 0.8).otherwise(0.5)).alias("score")).withColumn("source", F.lit(source)).withColumn("order", F.lit(order))
    rows = first.select("question", "id", "score", "source", "order").unionByName(step(graph.callers(edges, seeds, depth, nodes), "caller", 1)).unionByName(step(graph.callees(edges, seeds, depth, nodes), "callee", 2))
    once = rows.groupBy("question", "id").agg(F.min(F.struct("order", "score", "source")).alias("best")).select("question", "id", "best.score", "best.source")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return materialise(once.withColumn("place", place).where(F.col("place") <= most), "evidence")


def prompts(found: DataFrame, symbols: DataFrame, relations: DataFrame, most_symbols: int = 10, most_relations: int = 20) -> DataFrame:
    """Question, prompt, tokens, from evidence (question, id, source, place) and relationships (source_id, ...)."""
    named = found.join(symbols.select("id", "full_name", "kind", "file_path", "start_line", "return_type"), "id")
    shown = named.where("source = 'symbol_search'").withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("place"))).where(F.col("n") <= most_symbols)
    line = F.concat(F.lit("### "), "full_name", F.lit("\n- Kind: "), "kind", F.lit("\n- File: "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")), F.coalesce(F.concat(F.lit("\n- Returns: "), "return_type"), F.lit("")), F.lit("\n\n"))
    blocks = shown.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "").alias("symbols"))
    links = found.join(relations, found["id"] == relations["source_id"]).groupBy("question", "from_name", "to_name", relations["kind"].alias("kind")).agg(F.min("place").alias("place"))
    links = links.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("place", "from_name", "to_name", "kind"))).where(F.col("n") <= most_relations)
    text = F.concat(F.lit("- "), "from_name", F.lit(" → "), "to_name", F.lit(": "), "kind", F.lit("\n"))
    lines = links.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "").alias("relations"))
    rows = found.select("question").distinct().join(blocks, "question", "left").join(lines, "question", "left").fillna("", ["symbols", "relations"])
    # The prompt's wording.
    prompt = F.concat(
        F.lit("You are a C# code expert. Answer based on the following code context.\n\nQuestion: "), "question", F.lit("\n\n## Relevant Code Symbols\n"), "symbols", F.lit("## Code Relationships\n"), "relations",
        F.lit("\nProvide a comprehensive answer explaining how the code works.\n"),
    )
    return rows.select("question", prompt.alias("prompt")).withColumn("tokens", prompt_tokens(F.col("prompt")))


def context(symbols: DataFrame, edges: DataFrame, questions: DataFrame, a_term: int = 5, most: int = 20, a_side: int = 5) -> tuple[DataFrame, DataFrame]:
    """Chosen symbols (question, id, score, place), and relationships (question, from_id, to_id, kind)."""
    by_term = asked_terms(questions, CONTEXT_STOP_WORDS)
    hits = search.find_symbols(symbols, by_term.select(F.col("term").alias("query")), a_term).withColumnRenamed("query", "term").join(by_term, "term")
    each = hits.groupBy("question", "id").agg(F.max_by("score", "place").alias("score"), F.min("place").alias("first"))
    chosen = each.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("first", F.desc("score"), "id"))).where(F.col("place") <= most).drop("first")
    chosen = materialise(chosen, "context")
    seeds = chosen.select(F.col("id").alias("seed")).distinct()
    side = lambda df, a, b: df.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("n") <= a_side).select("seed", F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    links = side(graph.callers(edges, seeds, 1), "node", "seed").unionByName(side(graph.callees(edges, seeds, 1), "seed", "node"))
    return chosen, links.join(chosen.select("question", F.col("id").alias("seed")), "seed").select("question", "from_id", "to_id", F.lit("Calls").alias("kind")).distinct()


def confidence(best: Column, n: Column, relations: Column) -> Column:
    """R6."""
    value = F.least(F.lit(1.0), 0.6 * best + 0.3 * F.least(F.lit(1.0), relations / F.lit(10.0)) + F.when(n >= 3, 0.1).otherwise(0.0))
    return F.when(n > 0, value).otherwise(F.lit(0.0))


def context_summary(questions: DataFrame, chosen: DataFrame, links: DataFrame) -> DataFrame:
    """Question, symbols, relations, tokens, confidence, sufficient."""
    a = chosen.groupBy("question").agg(F.count(F.lit(1)).alias("symbols"), F.max("score").alias("best"))
    b = links.groupBy("question").agg(F.count(F.lit(1)).alias("relations"))
    rows = questions.select("question").distinct().join(a, "question", "left").join(b, "question", "left").fillna(0, ["symbols", "relations"]).fillna(0.0, ["best"])
    rows = rows.withColumn("tokens", prompt_tokens(F.col("question")) + 50 * F.col("symbols") + 20 * F.col("relations")).withColumn("confidence", confidence(F.col("best"), F.col("symbols"), F.col("relations")))
    return rows.select("question", "symbols", "relations", "tokens", "confidence", (F.col("confidence") > 0.65).alias("sufficient"))


def context_prompts(questions: DataFrame, chosen: DataFrame, links: DataFrame, symbols: DataFrame, most_relations: int = 20) -> DataFrame:
    """Question, prompt of a context (chosen and links as context() gives them); parts without rows are left out."""
    gathered = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("line").alias("t")))), lambda x: x["t"]), "")
    named = chosen.join(symbols.select("id", "full_name", "kind", "file_path", "start_line", "return_type"), "id")
    # The prompt's wording.
    line = F.concat(F.lit("- **"), "full_name", F.lit("** ("), "kind", F.lit(")\n  File: "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce("start_line", F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit("\n  Returns: "), "return_type"), F.lit("")), F.lit("\n\n"))
    one = named.withColumn("line", line).groupBy("question").agg(F.concat(F.lit("## Relevant Symbols\n"), gathered(["place"])).alias("symbols"))
    name = lambda k: symbols.select(F.col("id").alias(f"{k}_id"), F.col("full_name").alias(k))
    said = links.join(name("from"), "from_id").join(name("to"), "to_id").withColumn("line", F.concat(F.lit("- "), "from", F.lit(" → "), "to", F.lit(": "), "kind", F.lit("\n")))
    said = said.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("from", "to"))).where(F.col("n") <= most_relations)
    two = said.groupBy("question").agg(F.concat(F.lit("## Relationships\n"), gathered(["n"]), F.lit("\n")).alias("relations"))
    rows = questions.select("question").distinct().join(one, "question", "left").join(two, "question", "left").fillna("", ["symbols", "relations"])
    prompt = F.concat(F.lit("You are a C# code expert. Answer based on the provided context.\n\nQuestion: "), "question", F.lit("\n\n"), "symbols", "relations", F.lit("Provide a comprehensive answer based on the above context.\n"))
    return rows.select("question", prompt.alias("prompt"))


def within_budget(rows: DataFrame, budget: int, by: list[str], order: list) -> DataFrame:
    """The first rows of each group whose tokens together stay within the budget."""
    total = F.sum("tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= budget)


def compressed(items: DataFrame, budget: int, least: float = 0.5) -> DataFrame:
    """The items of each question (question, id, kind: symbol, snippet or relation, score, distance, content, tokens) in
    four steps, each for the questions whose tokens still exceed the budget: scores below least go; snippets are cut to
    equal shares of the budget; relations of more than one step go; then the first items, symbols before others and by
    score, that fit."""
    by = Window.partitionBy("question")
    total = lambda df: df.withColumn("total", F.sum("tokens").over(by))
    rows = total(items).where((F.col("total") <= budget) | (F.col("score") >= least))
    snippet = F.col("kind") == "snippet"
    share = F.expr(f"{budget} div n").cast("long")
    rows = total(rows).withColumn("n", F.greatest(F.count_if(snippet).over(by), F.lit(1))).withColumn("cut", (F.col("total") > budget) & snippet & (F.col("tokens") > share))
    rows = rows.withColumn("content", F.when(F.col("cut"), F.substring("content", F.lit(1), (share * 4).cast("int"))).otherwise(F.col("content"))).withColumn("tokens", F.when(F.col("cut"), share).otherwise(F.col("tokens")))
    rows = total(rows).where((F.col("total") <= budget) | (F.col("kind") != "relation") | (F.col("distance") <= 1))
    order = by.orderBy(F.col("kind") != "symbol", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = total(rows).withColumn("upto", F.sum("tokens").over(order))
    return rows.where((F.col("total") <= budget) | (F.col("upto") <= budget)).select("question", "id", "kind", "score", "content", "tokens")


def entities(questions: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """Question columns with place (from 1), words, name, id: what of a dictionary (name, id) is named in each question
    (question and others).

    Questions are cut into words by marks and spaces, lower-cased; each run of up to longest words is looked up, so this is
    one equi-join on whole names. A name within a longer one that is found isn't reported; of names with several ids all
    are. Names of more words than longest are never found; null questions and names hold nothing; questions' rows are told
    apart by all their columns, and repeated ones are one.
    """
    cut = lambda c: F.filter(F.split(F.lower(c), r"[\s.,;:?!()'\"]+"), lambda w: w != "")
    asked = materialise(questions.distinct().withColumn("_id", F.monotonically_increasing_id()), "asked")  # runs carry a number, not the text
    words = asked.select("_id", cut("question").alias("_words"))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_words")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("place"), n.alias("words")))))
    runs = words.where(F.size("_words") > 0).withColumn("_run", F.explode(F.filter(starts, lambda r: r["place"] + r["words"] - 1 <= F.size("_words"))))
    runs = runs.select("_id", "_run.place", "_run.words", F.array_join(F.slice("_words", F.col("_run.place"), F.col("_run.words")), " ").alias("name"))
    known = names.select(F.array_join(cut("name"), " ").alias("name"), "id").where("name != ''").distinct()
    hits = runs.join(known, "name")
    within = F.collect_set(F.struct("place", "words")).over(Window.partitionBy("_id"))  # a question's own hits
    hits = hits.withColumn("_all", within)
    inside = F.exists("_all", lambda o: (o["words"] > F.col("words")) & (o["place"] <= F.col("place")) & (o["place"] + o["words"] >= F.col("place") + F.col("words")))
    return hits.where(~inside).drop("_all").join(asked, "_id").select(*questions.columns, "place", "words", "name", "id")


def strategy(question: Column, found: Column) -> Column:
    """Where to look: what the intent asks for, if something is named to begin with; else a search."""
    return F.when(found == 0, "search").when(intent(question).isin("Callers", "Impact"), "callers").when(intent(question).isin("Implementations", "Hierarchy"), "types").when(found > 1, "paths").otherwise("neighbourhood")


def versions(writes: DataFrame) -> DataFrame:
    """Id, model, vector and others with version (from 1), valid_from, valid_to (null: still) of writes (id, model, at):
    each is valid until the next one of its id and model. Writes of one time: the one with the largest seq stays."""
    w = Window.partitionBy("id", "model").orderBy("at")
    last = writes.withColumn("_n", F.row_number().over(Window.partitionBy("id", "model", "at").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    return last.withColumns({"version": F.row_number().over(w), "valid_to": F.lead("at").over(w)}).withColumnRenamed("at", "valid_from")


def as_of(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (id, model, time and others) with the version, valid_from and seq that held (versions()) has at that time;
    nulls before the first. Both sides are put in one order of time and the last version is carried on, so there is no join
    on a range; versions of an id and model meet in one task, as rows that are read one after another."""
    one = held.select("id", "model", F.col("valid_from").alias("_at"), F.struct("version", "valid_from", "seq").alias("_held"), F.lit(None).cast(asked.schema.simpleString()).alias("_asked"))
    two = asked.select("id", "model", F.col("time").alias("_at"), F.lit(None).cast(one.schema["_held"].dataType).alias("_held"), F.struct(*asked.columns).alias("_asked"))
    order = Window.partitionBy("id", "model").orderBy("_at", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_last", F.last("_held", True).over(order))
    return both.where("_asked is not null").select("_asked.*", "_last.version", "_last.valid_from", "_last.seq")


def intent(question: Column) -> Column:
    """What a question is after."""
    q = F.lower(question)
    has = lambda *words: F.coalesce(*[F.when(F.contains(q, F.lit(w)), True) for w in words], F.lit(False))
    return F.when(has("who calls", "caller"), "Callers").when(has("implement"), "Implementations").when(has("inherit", "derive"), "Hierarchy").when(has("impact", "affect", "break"), "Impact").when(has("how"), "Explain").otherwise("Search")


def chunk_lines(files: DataFrame, size: int = 100) -> DataFrame:
    """file_path, start_line, end_line (from 1), content, content_hash, tokens: windows of so many lines."""
    lines = F.split("content", "\n", -1)
    rows = files.select("file_path", lines.alias("lines")).select("file_path", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size))).alias("at"))
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n")
    rows = rows.select("file_path", (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + size, F.size("lines")).alias("end_line"), text.alias("content"))
    return rows.withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("tokens", chunk_tokens(F.col("content")))


def chunk_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One chunk a symbol: its lines; none if they lie outside the file."""
    rows = symbols.join(files.select("file_path", F.split("content", "\n", -1).alias("lines")), "file_path")
    a, b = F.greatest(F.col("start_line"), F.lit(0)), F.least(F.col("end_line"), F.size("lines") - 1)
    rows = rows.withColumn("a", a).withColumn("b", b).where("a < size(lines) and b >= a")
    text = F.array_join(F.slice("lines", F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n")
    rows = rows.select("id", "name", "full_name", "file_path", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), text.alias("content"), F.when(F.col("kind") == "Type", "Type").otherwise("Method").alias("chunk_type"))
    return rows.withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("tokens", chunk_tokens(F.col("content")))


def chunk_with_context(chunks: DataFrame, related: DataFrame) -> DataFrame:
    """Chunks (id, full_name, content) under a header with up to 5 related names; related has id, place, related."""
    names = related.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "related"))), lambda x: x["related"]).alias("names"))
    header = F.concat(F.lit("// Symbol: "), "full_name", F.lit("\n"), F.when(F.size("names") > 0, F.concat(F.lit("// Related: "), F.array_join(F.slice("names", 1, 5), ", "), F.lit("\n"))).otherwise(""), F.lit("\n"))
    rows = chunks.join(names, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.select("id", "full_name", F.concat(header, "content").alias("content"), F.array_join("names", ",").alias("related"))
    return rows.withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("tokens", chunk_tokens(F.col("content")))


def chunk_by(files: DataFrame, chunker: Callable[[str], list[str]]) -> DataFrame:
    """The chunker seam: file_path, chunk_index, content by any function of a text."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, c) for p, t in zip(pdf["file_path"], pdf["content"], strict=True) for i, c in enumerate(chunker(t or ""))]
            yield pd.DataFrame(rows, columns=["file_path", "chunk_index", "content"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, chunk_index int, content string")


def model_dimension(model: Column) -> Column:
    """V2."""
    return F.when(F.contains(model, F.lit("mxbai")) | F.contains(model, F.lit("bge-m3")), 1024).otherwise(768)


def hashing_embedder(texts: pd.Series, size: int = 64) -> pd.Series:
    """A deterministic embedder for use without a model server: signed counts of hashed words, of unit length."""
    import zlib

    def one(t):
        if t is None:
            return None
        v = np.zeros(size, np.float32)
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h >> 16 & 1 else -1.0
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return texts.map(one)


def available(embedder: Callable[[pd.Series], pd.Series]) -> bool:
    """Whether the embedder answers."""
    try:
        return embedder(pd.Series(["x"])).iloc[0] is not None
    except Exception:  # the model's own
        return False


def models(cache: DataFrame) -> DataFrame:
    """Model, texts, dimension of what was embedded so far (content_hash, model, vector)."""
    return cache.groupBy("model").agg(F.count_distinct("content_hash").alias("texts"), F.max(F.size("vector")).alias("dimension"))


def embed(chunks: DataFrame, cache: DataFrame, model: str, embedder: Callable[[pd.Series], pd.Series] = hashing_embedder) -> DataFrame:
    """file_path, chunk_index, content_hash, model, vector; only what the cache (content_hash, model, vector)
    lacks is embedded, each text once. A text that the embedder fails on has a null vector."""
    def run(texts: pd.Series) -> pd.Series:
        return embedder(texts)

    udf = F.pandas_udf(run, "array<float>")
    keyed = chunks.withColumn("content_hash", ids.text_hash(F.col("content"))).withColumn("model", F.lit(model))
    known = cache.select("content_hash", "model", "vector")
    new = cache_misses(keyed, known).select("content_hash", "model", udf("content").alias("vector"))
    return keyed.join(known.unionByName(new), ["content_hash", "model"], "left").select("file_path", "chunk_index", "content_hash", "model", "vector")


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """V1: distinct contents that the cache (content_hash, model) lacks."""
    return chunks.join(cache, ["content_hash", "model"], "left_anti").groupBy("content_hash", "model").agg(F.min("content").alias("content"))


def batched(rows: DataFrame, size: int = 32, order: str = "content_hash") -> DataFrame:
    """V3: rows with batch, so many to each; numbers run within each hash prefix, so no single task orders all."""
    part = F.substring(F.md5(order), 1, 2)
    return rows.withColumn("part", part).withColumn("batch", F.expr("(row_number() over (partition by part order by " + order + ") - 1) div " + str(size)))


def embed_queue(pending: DataFrame, embedder: Callable[[pd.Series], pd.Series], most: int = 3, size: int = 32) -> tuple[DataFrame, DataFrame]:
    """V3, ST9, D17: vectors (content_hash, model, vector, tries) and what failed (content_hash, model, content, tries) of
    the texts that wait (content_hash, model, content).

    A batch of size texts is one call of the embedder; a batch that fails is queued again by itself, at most so many times,
    so one bad text doesn't hold up others. Each round writes what it embedded; equal texts are embedded once."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                some = pdf.iloc[at : at + size]
                try:
                    found = list(embedder(some["content"]))
                except Exception:  # the model's own: the batch is asked for again
                    found = [None] * len(some)
                yield some[["content_hash", "model", "content"]].assign(vector=found)

    left, done = pending.select("content_hash", "model", "content").dropDuplicates(["content_hash", "model"]), None
    for tries in range(1, most + 1):
        out = materialise(left.mapInPandas(run, "content_hash string, model string, content string, vector array<float>"), "embedded")
        good = out.where("vector is not null").select("content_hash", "model", "vector", F.lit(tries).alias("tries"))
        done = good if done is None else done.unionByName(good)
        left = out.where("vector is null").select("content_hash", "model", "content")
        if left.isEmpty():
            break
        size = max(1, size // 4) if tries + 1 < most else 1  # smaller batches, at last single texts, set a bad one apart
    return done, left.withColumn("tries", F.lit(tries))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """V4, Q21: embeddings of changed files are replaced as a whole."""
    return old.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)


#: Queries and vectors of a block, and queries of a block that are held against its vectors at a time.
QUERIES_AT_ONCE, VECTORS_AT_ONCE, TILE = 16_384, 8_192, 256
#: Share of the largest possible score by which sums in another order may differ, generously.
ROUNDING = 1e-10


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _summed(terms: Callable[[int], np.ndarray], length: int) -> np.ndarray:
    """terms(0) + terms(1) + ..., one after another, as the functions of functions.text add them up."""
    out = terms(0) + 0.0
    for i in range(1, length):
        out += terms(i)
    return out


def best_of_block(most: int, measure: str, kinds: tuple[str, str]):
    """A function of a block of vectors and one of queries, all of one length: query, id, score of each query's best most.

    Matrix products tell which pairs can be among them, up to rounding; these are then scored exactly, term by term, and of
    equal scores the smallest ids stay."""
    schema = _arrow_schema(f"query {kinds[0]}, id {kinds[1]}, score double")

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors["id"], null_placement="at_start"))
        x, asked, n = _numbers(vectors["vector"]), _numbers(queries["target"]), min(most, vectors.num_rows)
        long = x.shape[1]
        square = lambda m: _summed(lambda i: m[:, i] * m[:, i], long)
        size, asks = square(x), square(asked)
        at, of, found = [], [], []
        for low in range(0, len(asked), TILE):
            y, b = asked[low : low + TILE], asks[low : low + TILE]
            near = y @ x.T
            if measure == "cosine":
                norm = np.sqrt(b)[:, None] * np.sqrt(size)[None, :]
                near, slack = np.divide(near, norm, out=np.zeros_like(near), where=norm > 0), np.full(len(y), ROUNDING)
            elif measure == "dot":
                slack = ROUNDING * np.sqrt(b * size.max())
            else:
                near, slack = 2 * near - size[None, :] - b[:, None], ROUNDING * (b + size.max())
            last = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
            rows, columns = np.nonzero(near >= (last - slack)[:, None])
            score = np.empty(len(rows))
            for cut in range(0, len(rows), 1 << 16):
                i, j = rows[cut : cut + (1 << 16)], columns[cut : cut + (1 << 16)]
                if measure == "euclidean":
                    exact = -np.sqrt(_summed(lambda k: (x[j, k] - y[i, k]) * (x[j, k] - y[i, k]), long))
                else:
                    exact = _summed(lambda k: x[j, k] * y[i, k], long)
                if measure == "cosine":
                    whole = np.sqrt(size[j]) * np.sqrt(b[i])
                    exact = np.divide(exact, whole, out=np.zeros_like(exact), where=whole > 0)
                score[cut : cut + (1 << 16)] = exact
            order = np.lexsort((columns, -score, rows))
            rows, columns, score = rows[order], columns[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            stays = place < n
            at.append(rows[stays] + low), of.append(columns[stays]), found.append(score[stays])
        at, of = pa.array(np.concatenate(at)), pa.array(np.concatenate(of))
        return pa.Table.from_arrays([queries["query"].take(at), vectors["id"].take(of), pa.array(np.concatenate(found))], names=["query", "id", "score"]).cast(schema)

    return run


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def vector_search(vectors: DataFrame, queries: DataFrame, most: int = 10, where: Column | None = None, measure: str = "cosine", least: float | None = None) -> DataFrame:
    """Query, id, score, the best of each query (query, collection, target).

    Each query is held against all vectors of its collection: vectors and queries are dealt in blocks, each two blocks of
    one length meet in a task, as a product of matrices, and only each query's best of a block are shuffled. What has no
    such product (nulls, numbers that are none or extreme, unequal lengths) is scored pair by pair. where is a predicate on
    vectors; least drops lower scores; euclidean distances are negated.
    """
    f = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: -euclidean(a, b)}[measure]
    rows = (vectors if where is None else vectors.where(where)).select("collection", "id", "vector")
    asked = queries.select(*[F.col(c).alias(c) for c in ("query", "collection", "target")])  # which may come from vectors
    plain = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & ((v == 0) | F.abs(v.cast("double")).between(1e-140, 1e140))), F.lit(False))
    rows, asked = rows.withColumn("_plain", plain("vector")), asked.withColumn("_plain", plain("target"))
    even, these = rows.where("_plain").withColumn("_long", F.size("vector")), asked.where("_plain").withColumn("_long", F.size("target"))
    by = ["collection", "_long"]
    parts = even.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(*by, F.greatest(F.ceil(F.col("n") / VECTORS_AT_ONCE), F.least(F.lit(32), F.ceil(F.col("n") / 1024))).cast("int").alias("_parts"))
    parts = materialise(parts.join(these.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("_blocks")), by, "left"), "vector-blocks", True)
    known = broadcast_if(parts, 100_000)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = even.join(known, by).where("_blocks > 0").withColumn("_part", dealt("id", "_parts")).withColumn("_block", every("_blocks")).select(*by, "_part", "_block", "id", "vector")
    two = these.join(known, by).withColumn("_block", dealt("query", "_blocks")).withColumn("_part", every("_parts")).select(*by, "_part", "_block", "query", "target")
    kinds = (dict(asked.dtypes)["query"], dict(rows.dtypes)["id"])
    block = [*by, "_part", "_block"]
    pairs = one.groupBy(*block).cogroup(two.groupBy(*block)).applyInArrow(best_of_block(most, measure, kinds), f"query {kinds[0]}, id {kinds[1]}, score double")
    others = these.join(known.select("collection", F.col("_long").alias("_other")), "collection").where("_long != _other").select("query", "collection", "target", F.col("_other").alias("_long"))
    scored = lambda df: df.select("query", "id", f(F.col("vector"), F.col("target")).alias("score"))
    pairs = pairs.unionByName(scored(even.join(others, by)))
    pairs = pairs.unionByName(scored(rows.where("not _plain").join(asked, "collection"))).unionByName(scored(rows.where("_plain").join(asked.where("not _plain"), "collection")))
    if least is not None:
        pairs = pairs.where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))  # limits each task's rows too
    return pairs.withColumn("place", place).where(F.col("place") <= most)


def scroll(vectors: DataFrame, collection: str, most: int, offset: int = 0) -> DataFrame:
    """V6, T8."""
    return vectors.where(F.col("collection") == collection).orderBy("id").offset(offset).limit(most)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """K9: a collection begins with its first vector; a vector of the same id is replaced."""
    return tables.upsert(vectors, new, ["collection", "id"])


def delete_vectors(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the vectors of gone (collection, id), or the whole collections of gone (collection)."""
    return vectors.join(gone.distinct(), [c for c in ("collection", "id") if c in gone.columns], "left_anti")


def collections(vectors: DataFrame) -> DataFrame:
    """V6, K9."""
    return vectors.select("collection").distinct()


def check_dimension(vectors: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """Q19: vectors whose length isn't their collection's."""
    wanted = F.try_element_at(F.create_map(*[x for k, v in dimensions.items() for x in (F.lit(k), F.lit(v))]), F.col("collection"))
    return vectors.where(F.size("vector") != wanted)
