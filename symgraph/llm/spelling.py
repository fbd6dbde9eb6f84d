"""Spelling variants: words one edit apart, and for each word the form that it is probably meant to be.

Candidates come from letter-parity masks. A word's mask has a bit for each letter class, set if the class occurs an odd
number of times; one inserted or deleted letter turns one bit, a replaced one two at most. The mask is split into three
bands, so two words one edit apart agree in a band, and their lengths differ by one at most. A band alone says little (on
0.1 GB of documents some 14,000 words share a band and a length with each word), so each bucket is split by the words'
halves: an edit leaves either the first half or the last one as it was. What meets in a bucket and turns two bits at most
is verified by its edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, text_of
from symgraph.session import materialise, rows

#: Of each byte in Latin-1: letters stay, A-Z lower-cased; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Bits of a mask: one for each of a-z, and the accented letters dealt over the rest.
BITS, BANDS = 33, 3
#: Words that a worker holds before it gives them out, and characters that it takes at a time.
HELD, PIECE = 200_000, 1 << 20


def runs(text: str):
    """Lists of the text's lower-cased runs of letters as Latin-1 bytes, in order; long texts give several lists."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        rest = text[at:end].encode("latin-1", "replace").translate(LETTERS)
        while end < len(text) and not rest.endswith(b" "):  # up to a separator, that no run is cut
            more = text[end : end + PIECE].encode("latin-1", "replace").translate(LETTERS)
            cut = more.find(b" ") + 1 or len(more)
            rest += more[:cut]
            end += cut
        yield rest.split()
        at = end


def spelt(doc_id: int | None, found: Counter, every: int, least: int) -> dict[bytes, int]:
    """What is counted of a document's runs: of those whose checksum every divides, without one letter."""
    start, out = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id), {}
    for run, n in found.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
        if len(run) >= least:
            out[run] = out.get(run, 0) + n
    return out


def words_of(docs: DataFrame, every: int = 31, least: int = 7, seen: int = 2) -> DataFrame:
    """word, n of all words of at least so many letters that occur so often; counts are added up before they are shuffled."""

    def run(batches):
        total: dict[bytes, int] = {}

        def given():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total]), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for i, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found: Counter = Counter()
                for some in runs(value.as_py()):
                    found.update(some)
                for w, n in spelt(i, found, every, least).items():
                    total[w] = total.get(w, 0) + n
                if len(total) >= HELD:
                    yield given()
        if total:
            yield given()

    counted = in_batches(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def mask_of(word: str) -> Column:
    """The parity of each letter class of a column, as bits."""
    bit = f"if(ascii(c) < 128, ascii(c) - 97, 26 + ascii(c) % {BITS - 26})"
    return F.expr(f"aggregate(split({word}, ''), 0L, (m, c) -> m ^ shiftleft(1L, {bit}))")


def bands_of(mask: Column) -> list[Column]:
    """Each band holds every third bit, so that common letters are spread."""
    return [mask.bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS)))) for k in range(BANDS)]


def keyed(words: DataFrame, longer: bool) -> DataFrame:
    """words with key, band, head for each bucket: of the lengths that the word has and, if longer, of the one before."""
    size = F.length("word")
    lengths = F.array(size, size - 1) if longer else F.array(size)
    half = F.shiftright("short", 1)
    buckets = [F.struct(F.lit(k).alias("band"), bits.alias("bits"), F.lit(head).alias("head")) for k, bits in enumerate(bands_of(F.col("mask"))) for head in (True, False)]
    part = F.when(F.col("b.head"), F.expr("left(word, short >> 1)")).otherwise(F.expr("right(word, short >> 1)"))
    out = words.withColumn("short", F.explode(lengths)).withColumn("b", F.explode(F.array(*buckets))).where(half > 0)
    return out.select("word", "n", "mask", "short", F.col("b.band").alias("band"), F.col("b.head").alias("head"), F.xxhash64("b.band", "b.bits", "short", "b.head", part).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, an, b, bn: each pair of words (word, n; at least two letters each) exactly one edit apart, once, with their counts."""
    marked = words.withColumn("mask", mask_of("word"))
    one = keyed(marked, False).select("key", "band", "head", "short", F.col("word").alias("a"), F.col("n").alias("an"), F.col("mask").alias("am"))
    two = keyed(marked, True).select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("mask").alias("bm"))
    turned = F.col("am").bitwiseXOR(F.col("bm"))
    before = [F.when(F.col("band") > k, bits != 0).otherwise(True) for k, bits in enumerate(bands_of(turned)[:-1])]  # a pair counts in the first band it agrees in
    once = F.col("head") | F.expr("left(a, short >> 1) != left(b, short >> 1)")
    ordered = (F.length("b") > F.col("short")) | (F.col("a") < F.col("b"))
    fits = (F.bit_count(turned) <= 2) & ordered & before[0] & before[1] & once
    return one.join(two, "key").where(fits & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")


def rooted(forms: DataFrame, most_rounds: int = 60) -> DataFrame:
    """forms (word, form) with root: where the forms lead from word to in the end. Each round doubles the steps taken."""
    known = materialise(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(known.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        known = now.select("word", "root")
    raise RuntimeError(f"roots did not settle in {most_rounds} rounds")


def variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text).

    Words are lower-cased (A-Z only) runs of ASCII letters and U+00C0 to U+00FF, seven letters at least and twice at least
    in all; of some runs, chosen by a checksum of doc_id and run, one letter is dropped first. A word's form is its most
    frequent near word (of equals the smallest), if that is at least ratio times as frequent; root follows the forms.

    Null texts count as empty; a null doc_id as an empty one; repeated rows count again; long texts are read in pieces; an
    empty table gives an empty result; other columns are not read. Texts are counted within tasks, so a frequent word is
    one row a task.
    """
    words = materialise(words_of(docs), "spelling-words", True)
    buckets = max(words.sparkSession.sparkContext.defaultParallelism, rows(words) // 50_000)
    pairs = materialise(near_pairs(words.repartition(buckets)), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form")).alias("near"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("an")).alias("less"), F.col("a").alias("form")).alias("near")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    counted = words.join(best, "word", "left").withColumn("taken", -F.col("near.less") >= F.col("n") * ratio)
    formed = counted.select("word", F.when(F.col("taken"), F.col("near.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("taken"), -F.col("near.less")).alias("form_n"))
    formed = materialise(formed, "spelling-forms")
    chains = formed.where("form is not null")
    ends = materialise(chains.select("word").unionByName(chains.select(F.col("form").alias("word"))).distinct(), "spelling-ends")
    roots = rooted(ends.join(chains.select("word", "form"), "word", "left"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: For DuckDB: CRC-32 as the exclusive or of what each byte gives, which depends on how many bytes follow it; near words by
#: their texts with one letter left out.
ORACLE = r"""
WITH RECURSIVE step(b, c, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM step WHERE k < 8),
byte AS MATERIALIZED (SELECT b, c FROM step WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
m AS (SELECT row_number() OVER () AS id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM runs),
after(k, b, c) AS (SELECT 0, b, c FROM byte UNION ALL SELECT k + 1, a.b, xor(a.c >> 8, t.c) FROM after a JOIN byte t ON t.b = a.c & 255 WHERE k < (SELECT max(len(bytes)) FROM m)),
spread AS (SELECT id, len(bytes) AS size, unnest(bytes) AS b, unnest(range(1, len(bytes) + 1)) AS i FROM m),
sums AS (SELECT id, xor(bit_xor(c), 4294967295) AS h FROM spread JOIN after ON k = size - i AND after.b = CASE WHEN i <= 4 THEN xor(spread.b, 255) ELSE spread.b END GROUP BY id),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM m JOIN sums USING (id)),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
 UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT a.word, count(*) AS n_near, max(b.n) AS most, min_by(other, (-b.n, other)) AS form FROM near a JOIN words b ON b.word = a.other GROUP BY a.word),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN most >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, here) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word) JOIN formed l ON l.word = w.here AND l.form IS NULL
"""
