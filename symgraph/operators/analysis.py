"""Impact, health and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.operators import graph


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    """A1, A18."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def repository_stats(symbols: DataFrame) -> DataFrame:
    """A2, A3, A4: counts by repository."""
    of = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return symbols.groupBy("repository").agg(
        F.count(F.lit(1)).alias("total"), F.count_if((F.col("kind") == "Type") & (F.col("type_name") == "Class")).alias("classes"), F.count_if((F.col("kind") == "Type") & (F.col("type_name") == "Interface")).alias("interfaces"),
        of("Method", "methods"), of("Property", "properties"), of("Field", "fields"), of("Namespace", "namespaces"),
    )


def members(symbols: DataFrame, container_only: bool = False) -> DataFrame:
    """owner and n, its members."""
    owner = F.col("container_id") if container_only else F.coalesce("container_id", "declaring_type_id")
    return symbols.select(owner.alias("owner")).where("owner is not null").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


def large_classes(symbols: DataFrame, over: int = 30, container_only: bool = False) -> DataFrame:
    """A5: repository, id, name, n of classes with more members."""
    classes = symbols.where("kind = 'Type' and type_name = 'Class'").select("repository", "id", "name")
    return classes.join(members(symbols, container_only), F.col("owner") == F.col("id")).where(F.col("n") > over).select("repository", "id", "name", "n")


def god_classes(symbols: DataFrame, edges: DataFrame, over: int = 20) -> DataFrame:
    """Classes with more outgoing Calls and Uses."""
    out = edges.where("kind in ('Calls', 'Uses')").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over)
    return symbols.where("kind = 'Type' and type_name = 'Class'").join(out, F.col("source_id") == F.col("id")).select("repository", "id", "name", "n")


def density(n: Column, e: Column) -> Column:
    """A7, in double precision; 0 for fewer than 2 nodes."""
    return F.when(n > 1, F.try_divide(e.cast("double"), n.cast("double") * (n.cast("double") - 1) / 2)).otherwise(F.lit(0.0))


def health_score(large: Column, cycles: Column, god: Column, dense: Column) -> Column:
    """A8."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - 5 * large - 15 * cycles - 10 * god - F.when(dense > 0.5, 5).otherwise(0)))


def health(symbols: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repository, score, counts, density, average edges, warnings, suggestions."""
    big = large_classes(symbols).select("repository", F.concat(F.lit("Large class: "), "name", F.lit(" has "), F.col("n").cast("string"), F.lit(" members")).alias("w"), F.lit("large").alias("what"))
    god = god_classes(symbols, edges).select("repository", F.concat(F.lit("God class detected: "), "name", F.lit(" has "), F.col("n").cast("string"), F.lit(" outgoing dependencies")).alias("w"), F.lit("god").alias("what"))
    core = graph.cyclic_core(edges)
    loops = nodes.where("kind = 'Class'").join(core, F.col("id") == F.col("node"), "left_semi").groupBy("repository").agg(F.min("label").alias("label"))
    loops = loops.select("repository", F.concat(F.lit("Potential circular dependency detected involving: "), "label").alias("w"), F.lit("cycle").alias("what"))
    warned = big.unionByName(god).unionByName(loops).groupBy("repository").agg(F.array_sort(F.collect_list("w")).alias("warnings"), *[F.count_if(F.col("what") == k).alias(f"n_{k}") for k in ("large", "god", "cycle")])
    n, e = nodes.groupBy("repository").agg(F.count(F.lit(1)).alias("nodes")), edges.groupBy("repository").agg(F.count(F.lit(1)).alias("edges"))
    rows = repository_stats(symbols).join(n, "repository", "left").join(e, "repository", "left").join(warned, "repository", "left")
    rows = rows.fillna(0, ["nodes", "edges", "n_large", "n_god", "n_cycle"]).withColumn("density", density(F.col("nodes"), F.col("edges")))
    rows = rows.withColumn("average", F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes")), F.lit(0.0)))
    advice = F.filter(F.array(F.when(F.col("density") > 0.5, F.lit("High graph density - consider reducing coupling")), F.when(F.col("total") > 10000, F.lit("Large codebase - consider modularization"))), lambda x: x.isNotNull())
    return rows.withColumns({"score": health_score(F.col("n_large"), F.col("n_cycle"), F.col("n_god"), F.col("density")), "warnings": F.coalesce("warnings", F.array().cast("array<string>")), "suggestions": advice})


def risk(callers: Column, callees: Column, refs: Column, derived: Column, implementations: Column) -> Column:
    """A9."""
    parts = ((callers, 5, 50), (callees, 2, 20), (refs, 1, 15), (derived, 10, 15), (implementations, 5, 10))
    total = F.lit(0)
    for n, each, most in parts:
        total = total + F.least(n * each, F.lit(most))
    return F.least(total, F.lit(100))


def risk_level(score: Column) -> Column:
    """A9."""
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").when(score >= 15, "LOW").otherwise("MINIMAL")


def summary(name: Column, kind: Column, callers: Column, callees: Column, refs: Column, derived: Column, implementations: Column, tests: Column) -> Column:
    """The sentences of an impact report."""
    say = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    text = lambda c: c.cast("string")
    return F.concat_ws(
        " ", say("Changing ", name, " (", kind, ") would directly affect ", text(callers), " caller(s)."), F.when(callees > 0, say("It calls ", text(callees), " other method(s).")), F.when(refs > 1, say("There are ", text(refs), " total references.")),
        F.when(derived > 0, say(text(derived), " type(s) inherit from this type.")), F.when(implementations > 0, say(text(implementations), " type(s) implement this interface.")),
        F.when(tests == 0, F.lit("⚠️ WARNING: No test coverage found.")).otherwise(say("✓ ", text(tests), " test(s) reference this symbol.")),
    )


def blast_radius(symbols: DataFrame, edges: DataFrame, refs: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """One row a seed with counts, score, level and summary. At depth 1 calls are degrees; derived types are
    counted as sizes of trees; so pairs are made for calls at depth 2 and more only."""
    at = lambda df, name, *more: df.groupBy("seed").agg(F.count(F.lit(1)).alias(name), *more)
    picked = symbols.join(seeds, F.col("id") == F.col("seed"), "left_semi")
    types, interfaces = (picked.where(c).select(F.col("id").alias("seed")) for c in ("kind = 'Type'", "kind = 'Type' and type_name = 'Interface'"))
    if depth == 1:  # degrees
        calls = edges.where("kind = 'Calls'").select("source_id", "target_id").distinct()
        one = lambda end, *names: calls.groupBy(F.col(end).alias("seed")).agg(*[F.count(F.lit(1)).alias(n) for n in names])
        up, down = one("target_id", "callers", "direct"), one("source_id", "callees")
    else:
        up = at(graph.callers(edges, seeds, depth), "callers", F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))
        down = at(graph.callees(edges, seeds, depth), "callees")
    derived = graph.count_below(edges.where("kind = 'Inherits'"), types).withColumnRenamed("n", "derived")
    implemented = edges.where("kind = 'Implements'").select("source_id", F.col("target_id").alias("seed")).distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("implementations"))
    implemented = implemented.join(interfaces, "seed", "left_semi")
    used = refs.groupBy(F.col("symbol_id").alias("seed")).agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.contains("context", F.lit("Test")) | F.contains("context", F.lit("test"))).alias("tests"))
    numbers = ["callers", "direct", "indirect", "callees", "refs", "tests", "derived", "implementations"]
    # one sum and one join in place of five joins, whose sorts a task would hold all at once
    parts = [df.select("seed", *[(F.col(n) if n in df.columns else F.lit(0)).cast("long").alias(n) for n in numbers]) for df in (up, down, used, derived, implemented)]
    counts = reduce(DataFrame.unionByName, parts).groupBy("seed").agg(*[F.sum(n).alias(n) for n in numbers])
    rows = picked.withColumn("seed", F.col("id")).join(counts, "seed", "left")
    rows = rows.fillna(0, numbers)
    c = {k: F.col(k) for k in numbers}
    rows = rows.withColumn("score", risk(c["callers"], c["callees"], c["refs"], c["derived"], c["implementations"]))
    text = summary(F.col("name"), F.col("kind"), *(c[k] for k in ("callers", "callees", "refs", "derived", "implementations", "tests")))
    return rows.select("seed", "full_name", "kind", *numbers, "score", risk_level(F.col("score")).alias("level"), text.alias("summary"))


def compare(symbols: DataFrame, one: str, two: str) -> DataFrame:
    """full_name, in_one, in_two, status (Common, UniqueToFirst or UniqueToSecond), kinds."""
    first = lambda r, c: symbols.where(F.col("repository") == r).groupBy("full_name").agg(F.min("kind").alias(c))
    rows = first(one, "kind_one").join(first(two, "kind_two"), "full_name", "full_outer")
    status = F.when(F.col("kind_one").isNull(), "UniqueToSecond").when(F.col("kind_two").isNull(), "UniqueToFirst").otherwise("Common")
    return rows.select("full_name", "kind_one", "kind_two", status.alias("status"))


def compare_counts(symbols: DataFrame, one: str, two: str) -> DataFrame:
    """One row of counts."""
    return compare(symbols, one, two).agg(*[F.count_if(F.col("status") == s).alias(c) for s, c in (("Common", "common"), ("UniqueToFirst", "unique_one"), ("UniqueToSecond", "unique_two"))])
