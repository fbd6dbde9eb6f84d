"""Symbol and source-text search; every operator answers any number of queries (column query) in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import contains_ci, terms, trigrams
from symgraph.operators.graph import neighbourhood
from symgraph.session import broadcast_if, materialise

SEARCHED = ("Type", "Method", "Property", "Field")
ORDER = ("full_name", "id")


def _ranked(rows: DataFrame, by: list[str], order: list, most: int, name: str = "_place") -> DataFrame:
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
    return rows.drop(name) if name == "_place" else rows


def _keyed(symbols: DataFrame, asked: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """query, columns, match for each query that is a symbol's full name, its name or, whatever the case, how it begins.

    Each symbol offers its names and the beginnings of its name that are as long as some query, so this is one equi-join on
    (match, _key) and one reading of the symbols; the driver gets the queries' different lengths."""
    low = F.lower("name")
    lengths = [r[0] for r in asked.select(F.length(F.lower("query"))).distinct().collect() if r[0] is not None]
    way = lambda match, key: F.struct(F.lit(match).alias("match"), key.alias("_key"))
    offered = [F.when(F.col("kind").isin(*SEARCHED) & (F.length(low) >= n), way("prefix", F.substring(low, 1, n))) for n in lengths]
    wanted = [way("prefix", F.lower("query"))]
    if exact:
        offered += [way("exact_full", F.col("full_name")), way("exact_name", F.col("name"))]
        wanted += [way("exact_full", F.col("query")), way("exact_name", F.col("query"))]
    if not offered:
        return symbols.limit(0).select(F.lit("").alias("query"), *columns, F.lit("").alias("match"))
    keys = symbols.select(*columns, F.inline(F.filter(F.array(*offered), lambda x: x.isNotNull())))
    return keys.join(broadcast_if(asked.select("query", F.inline(F.array(*wanted))), 100_000), ["match", "_key"]).select("query", *columns, "match")


def by_prefix(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """H2: query and symbol, where the name begins with the query, whatever its case."""
    return _keyed(symbols, queries.select("query").distinct(), symbols.columns, exact=False).drop("match")


def trigram_index(symbols: DataFrame) -> DataFrame:
    """H3: id, gram for each distinct trigram of a symbol's name; write it bucketed by gram to reuse it."""
    return symbols.where(F.col("kind").isin(*SEARCHED)).select("id", F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram"))


def by_trigrams(symbols: DataFrame, queries: DataFrame, most: int = 20, index: DataFrame | None = None, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """Query, id, overlap, graded score 0.3 + 0.4 * overlap / trigrams of the query; the best most of each.

    Repeated trigrams of a query count each time. Queries' grams are summed before the join, so it is an equi-join of
    one row a gram and query. by may add repository: then the best of each repository."""
    best = _overlaps(symbols, queries.select("query").distinct(), ["id", "full_name"], index, by, most)
    return best.select(*by, "id", "overlap", "graded")


def _overlaps(symbols: DataFrame, asked: DataFrame, columns: list[str], index: DataFrame | None, by: tuple[str, ...], most: int) -> DataFrame:
    """by, columns, overlap, graded of the best most. Without an index the symbols are read once.

    Queries' grams go to the symbols, unless they are very many: so no gram's symbols meet in one task, and only symbols
    that share a gram with a query are shuffled, by query and symbol."""
    own = [*by[1:], *columns]
    grams = asked.select("query", F.explode(trigrams(F.col("query"))).alias("gram")).groupBy("query", "gram").agg(F.count(F.lit(1)).alias("times"))
    grams = materialise(grams.withColumn("grams", F.sum("times").over(Window.partitionBy("query"))), "query-grams", True)
    grams = broadcast_if(grams, 100_000)
    if index is None:
        held = symbols.where(F.col("kind").isin(*SEARCHED)).select(*own, F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram"))
        hits = held.join(grams, "gram").groupBy("query", *own, "grams").agg(F.sum("times").alias("overlap"))  # all of fixed width or keys: hashed, not sorted
    else:
        hits = index.join(grams, "gram").groupBy("query", "id", "grams").agg(F.sum("times").alias("overlap")).join(symbols.select(*own), "id")
    best = _ranked(hits, list(by), [F.desc("overlap"), *ORDER], most)
    return best.select("query", *own, "overlap", (F.lit(0.3) + F.lit(0.4) * F.col("overlap") / F.col("grams")).alias("graded"))


def tiered(symbols: DataFrame, queries: DataFrame, fewest: int = 5, graded: bool = False, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """H1: by, id, name, full_name, kind, score, match of all hits.

    Tiers: full name 1.0, name 0.9, prefix 0.7, and where there are fewer hits than fewest, trigrams 0.4 (or graded). A
    symbol keeps its best tier. The hits of the first three are written, as they also say which queries need the last."""
    columns = [*by[1:], "id", "name", "full_name", "kind"]
    asked = materialise(queries.select("query").distinct(), "queries", True)
    score = F.when(F.col("match") == "exact_full", 1.0).when(F.col("match") == "exact_name", 0.9).otherwise(0.7)
    tiers = materialise(_keyed(symbols, asked, columns).withColumn("score", score), "tiers")
    enough = tiers.groupBy(*by).agg(F.count_distinct("id").alias("n")).where(F.col("n") >= fewest)
    open_ = asked if len(by) > 1 else asked.join(enough, "query", "left_anti")
    fuzzy = _overlaps(symbols, open_, columns[len(by) - 1 :], None, by, 20)
    fuzzy = fuzzy.select("query", *columns, (F.col("graded") if graded else F.lit(0.4)).alias("score"), F.lit("fuzzy").alias("match"))
    if len(by) > 1:
        fuzzy = fuzzy.join(enough, list(by), "left_anti")
    both = tiers.unionByName(fuzzy)
    best = both.groupBy(*by, "id").agg(F.max(F.struct("score", "match", "name", "full_name", "kind")).alias("best"))
    return best.select(*by, "id", "best.name", "best.full_name", "best.kind", "best.score", "best.match")


def find_symbols(symbols: DataFrame, queries: DataFrame, most: int = 50, fewest: int = 5, kind: str | None = None, graded: bool = False) -> DataFrame:
    """Query, id, name, full_name, kind, score, match, the best most of each query.

    The kind filter follows the tiers: it comes after the count that opens the last one."""
    hits = tiered(symbols, queries, fewest, graded)
    if kind:
        hits = hits.where(F.col("kind") == kind)
    return _ranked(hits, ["query"], [F.desc("score"), *ORDER], most).select("query", "id", "name", "full_name", "kind", "score", "match")


def find_across(symbols: DataFrame, queries: DataFrame, most: int = 20, a_repository: int = 50) -> DataFrame:
    """The best over all repositories, each searched by itself; with the repository."""
    by = ["query", "repository"]
    hits = _ranked(tiered(symbols, queries, by=tuple(by)), by, [F.desc("score"), *ORDER], a_repository)
    return _ranked(hits, ["query"], [F.desc("score"), "repository", *ORDER], most)


#: Letters of a gram, and how many of a query's grams, the rarest, are looked up.
GRAM, RAREST = 3, 3


def postings(rows: DataFrame, text: Column, sizes: tuple[int, ...] = (1, 2, GRAM)) -> DataFrame:
    """_key, gram: the different runs of so many letters in the lower-cased text of each row (_key). An index of all sizes
    answers queries of any length."""
    letters = rows.select("_key", F.split(F.lower(text), "").alias("_c"))  # whose elements are found at once, unlike a text's
    runs = lambda n: F.slice(F.transform("_c", lambda c, i: F.concat(c, *[F.coalesce(F.get("_c", i + k), F.lit("")) for k in range(1, n)])), 1, F.greatest(F.size("_c") - (n - 1), F.lit(0)))
    return letters.select("_key", F.explode(F.concat(*[F.array_distinct(runs(n)) for n in sizes])).alias("gram")).where("gram != ''")


def containing(rows: DataFrame, text: Column, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """query, _key of the rows (_key) whose text may contain a query, whatever its case: rows that have the query's rarest
    grams. Callers verify. No row is held against a query with which it has no gram in common; queries of one or two letters
    are grams themselves. Without an index (postings()) the rows' grams are made here."""
    low, n = F.lower("query"), F.least(F.lit(GRAM), F.length(F.lower("query")))
    asked = queries.select("query").distinct().where(F.length(low) > 0)
    wanted = asked.select("query", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n)))).alias("gram"))
    wanted = materialise(wanted, "asked-grams", True)
    if index is None:
        index = postings(rows, text, tuple(sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())) or (GRAM,))
    held = materialise(index.join(broadcast_if(wanted.select("gram").distinct(), 100_000), "gram", "left_semi"), "posting-lists")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rare = wanted.join(often, "gram", "left").withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("often").asc_nulls_first(), "gram"))).where(F.col("_place") <= RAREST)
    bit = F.expr("shiftleft(1, _place - 1)")
    rare = materialise(rare.select("query", "gram", bit.alias("bit"), F.sum(bit).over(Window.partitionBy("query")).alias("need")), "rare-grams", True)
    found = held.join(broadcast_if(rare, 100_000), "gram").groupBy("query", "_key").agg(F.bit_or("bit").alias("has"), F.first("need").alias("need"))
    return found.where("has = need").select("query", "_key")  # a repeated row sets its bits again


def file_key(files: DataFrame) -> DataFrame:
    """files with _key, which a stored index of their lines refers to."""
    return files.withColumn("_key", F.xxhash64("file_path", "content"))


def text_index(files: DataFrame) -> DataFrame:
    """postings() of files; write it, bucketed by gram if it is large, to answer source_text() many times. Made without a
    shuffle: a repeated file has its postings again, which containing() counts once."""
    return postings(file_key(files.where("content is not null")), F.col("content"))


def source_text(files: DataFrame, queries: DataFrame, most: int | None = 20, symbols: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """H7: query, file_path, line (from 1), content (trimmed), score: 1.0 where the line begins with the query, else 0.8.

    With symbols, only files that have a Type or Method. Blank queries and files without content give nothing.
    Only files that have a query's rarest grams are cut into lines, which are then verified; index is text_index(files).
    """
    if symbols is not None:
        files = files.join(symbols.where("kind in ('Type', 'Method')").select("file_path").distinct(), "file_path", "left_semi")
    asked = queries.select("query").distinct().where("trim(query) != ''")
    keyed = file_key(files.where("content is not null"))
    may = containing(keyed, F.col("content"), asked, index).groupBy("_key").agg(F.collect_list("query").alias("queries"))
    may = keyed.join(broadcast_if(materialise(may, "text-candidates", True), 100_000), "_key")
    lines = may.select("file_path", "queries", F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "text"))
    hits = lines.select("file_path", "line", "text", F.explode(F.filter("queries", lambda q: contains_ci(F.col("text"), q))).alias("query"))
    rows = hits.select("query", "file_path", (F.col("line") + 1).alias("line"), F.trim("text").alias("content"), F.when(F.startswith(F.lower("text"), F.lower("query")), 1.0).otherwise(0.8).alias("score"))
    return rows if most is None else _ranked(rows, ["query"], [F.desc("score"), "file_path", "line"], most)


def search_code(symbols: DataFrame, files: DataFrame, queries: DataFrame, most: int = 20, index: DataFrame | None = None) -> DataFrame:
    """H8: query, source (symbol or text), place, score."""
    one = find_symbols(symbols, queries, most).select("query", F.lit("symbol").alias("source"), F.col("full_name").alias("place"), "score")
    two = source_text(files, queries, most, index=index).select("query", F.lit("text").alias("source"), F.concat_ws(":", "file_path", F.col("line").cast("string")).alias("place"), "score")
    return one.unionByName(two)


def fused(ranked: DataFrame, graph_scores: DataFrame, most: int = 10, k: int = 60, weight: float = 0.5) -> DataFrame:
    """Query, id, score, fuzzy_score, graph_score from ranked (query, id, rank) and graph_scores (query, id, score).

    Reciprocal ranks are summed, the best graph score is added; the limit comes last, so rows without a symbol must be
    gone from the inputs.
    """
    one = ranked.groupBy("query", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("fuzzy_score"))
    two = graph_scores.groupBy("query", "id").agg(F.max("score").alias("graph_score"))
    rows = one.join(two, ["query", "id"], "full_outer").fillna(0.0, ["fuzzy_score", "graph_score"])
    rows = rows.withColumn("score", F.col("fuzzy_score") + weight * F.col("graph_score"))
    return _ranked(rows, ["query"], [F.desc("score"), "id"], most)


def hybrid(symbols: DataFrame, edges: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """Candidates of find_symbols, fused with the neighbourhoods of each term's best symbols."""
    asked = queries.select("query").distinct()
    found = find_symbols(symbols, asked, most * 3)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *ORDER))).select("query", "id", "rank")
    by_term = asked.select("query", F.explode(terms(F.col("query"))).alias("term"))
    seeds = find_symbols(symbols, by_term.select(F.col("term").alias("query")), 5).select(F.col("query").alias("term"), F.col("id").alias("seed")).join(by_term, "term").select("query", "seed").distinct()
    near = neighbourhood(edges, seeds.select("seed").distinct()).join(seeds, "seed").select("query", F.col("node").alias("id"), "score")
    near = near.join(symbols.select("id"), "id", "left_semi")
    return fused(ranked, near, most).join(symbols.select("id", "full_name"), "id")


def repositories_of(symbols: DataFrame) -> DataFrame:
    """full_name, repositories."""
    return symbols.groupBy("full_name").agg(F.count_distinct("repository").alias("repositories"))


def reference_relevance(refs: DataFrame) -> DataFrame:
    """Refs with score by kind, halved where nothing is known of the place."""
    kind = F.when(F.col("kind") == "Call", 1.0).when(F.col("kind").isin("Write", "Type"), 0.8).otherwise(0.6)
    return refs.withColumn("score", kind * F.when(F.col("context").isNull(), 0.5).otherwise(1.0))


def snippets(files: DataFrame, places: DataFrame, around: int = 2) -> DataFrame:
    """file_path, line, snippet: the lines around each place (file_path, line from 1)."""
    rows = places.join(files.select("file_path", F.split("content", "\n", -1).alias("lines")), "file_path")
    first = F.greatest(F.col("line") - around, F.lit(1))
    text = F.array_join(F.slice("lines", first, F.col("line") + around - first + 1), "\n")
    return rows.select("file_path", "line", text.alias("snippet"))
