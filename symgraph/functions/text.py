"""Text and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that questions are stripped of.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "how", "what", "does", "do", "in", "to", "for", "of", "and", "or", "not", "this", "that", "why", "when", "where", "which"]
#: The shorter list of the context builder.
CONTEXT_STOP_WORDS = STOP_WORDS[:19]


def trigrams(s: Column) -> Column:
    """Sliding trigrams of the lower-cased text, repeats kept; a shorter text is its own."""
    low = F.lower(s)
    return F.when(F.length(low) < 3, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def contains_ci(s: Column, part: Column) -> Column:
    return F.contains(F.lower(s), F.lower(part))


def terms(question: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of over two letters that aren't stop words, then stripped of marks at their ends; repeats kept."""
    words = F.filter(F.split(question, " "), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stop))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,?!]+|[.,?!]+$", "")), lambda w: w != "")


def prompt_tokens(s: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(s) / 4).cast("long")


def chunk_tokens(s: Column) -> Column:
    """A third of the characters, rounded up."""
    return F.ceil(F.length(s) / F.lit(3.0)).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.try_divide(dot(a, b), norm)).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors of one length; else null."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares))


def segments_outside(path: Column, excluded: list[str]) -> Column:
    """True if no whole segment of the path is excluded, whatever its case."""
    return ~F.arrays_overlap(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), F.array(*[F.lit(e.lower()) for e in excluded]))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def dirname(path: Column) -> Column:
    """Folder of a path, or empty."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
