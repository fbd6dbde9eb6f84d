import random
from itertools import combinations

import pytest

import corpus_pipeline
from symgraph.llm import jaccard, simhash
from symgraph.session import table

WORDS = [f"w{i}" for i in range(5000)]


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def brute_kept(rows):
    """The smallest doc_id of each component of pairs at 0.8 or more."""
    found, root = [shingles_of(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if alike(found[i], found[j]) and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    return sorted(min(d for (d, _), s in zip(rows, root, strict=True) if s == r) for r in set(root))


def planted():
    """Pairs of 600 words at similarities from below 0.8 to 0.95, by replaced words; and a chain whose ends are far apart."""
    rng = random.Random(7)
    rows, close = [], 0
    for k in range(60):
        base = rng.choices(WORDS, k=600)
        other = base[:]
        for at in rng.sample(range(600), 3 + k % 14):
            other[at] = "new"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        common, either = (len(f(*map(shingles_of, (rows[-1][1], rows[-2][1])))) for f in (set.intersection, set.union))
        close += 0.8 <= common / either <= 0.96
    base = rng.choices(WORDS, k=200)
    for k in range(8):
        base = base[4:] + rng.choices(WORDS, k=4)
        rows.append((500 + k, " ".join(base)))
    assert close > 30
    return rows


def test_stage_drops_near_copies_at_four_fifths(spark):
    rows = planted() + [(900, None), (901, " \t"), (902, "one two"), (903, "ONE  two"), (904, "one three"), (905, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == brute_kept(rows)


@pytest.mark.parametrize("most", [jaccard.BROADCAST_ROWS, 5])
def test_group_of_edited_copies_and_real_texts(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
    rng, rows = random.Random(3), [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    base = rng.choices(WORDS, k=150)
    for k in range(150):
        edited = base[:]
        for at in rng.sample(range(150), rng.randrange(12)):
            edited[at] = f"edit{k}"
        rows.append((10_000 + k, " ".join(edited)))
    left = simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == brute_kept(rows)


def test_stage_verifies_what_fingerprints_link(spark, monkeypatch):
    """A repeated passage weighs as often as it is repeated in a fingerprint, but once in a set of shingles: that link isn't
    confirmed; another one is."""
    rng = random.Random(5)
    passage = rng.choices(WORDS, k=9)
    base = rng.choices(WORDS, k=900)
    texts = [passage * 40 + rng.choices(WORDS, k=20), passage * 40 + rng.choices(WORDS, k=20), base, [*base[:-1], "edit"], rng.choices(WORDS, k=60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    near = {(i, j) for i, j in combinations(range(5), 2) if (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() <= 4}
    assert near == {(0, 1), (2, 3)}
    docs, checked, check = spark.createDataFrame(rows, "doc_id long, text string"), [], jaccard.verified
    name = {r.x: r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(text) x").collect()}
    monkeypatch.setattr(jaccard, "verified", lambda known, pairs: checked.append({tuple(sorted((name[r.u], name[r.v]))) for r in pairs.collect()}) or check(known, pairs))
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 4] == brute_kept(rows) and near <= checked[0]
