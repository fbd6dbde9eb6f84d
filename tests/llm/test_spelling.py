import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from symgraph.llm import spelling
from symgraph.session import table


def lowered(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def counted(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def formed(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()]


def planted():
    rng, rows = random.Random(5), []
    letters = "abcdefghijklmnopqrstuvwxyzéßÿÉ×"
    for k in range(60):
        base = "".join(rng.choices(letters, k=rng.randint(7, 12)))
        rows += [(7 * k + j, f"{base.upper() if base.isascii() else base} {base}, {base}-{base}") for j in range(8)]
        for j in range(4):
            at, how = rng.randrange(len(base)), rng.choice("irdr")
            other = base[:at] + (rng.choice(letters) if how != "d" else "") + base[at + (how != "i") :]
            rows += [(900 + 5 * k + j, f"{other} {other}")]
            far = other[:-1] + rng.choice(letters)
            rows += [(None, f"{far}1{far}")]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = formed(counted(rows))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[1] is not None for r in want) > 50


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r.word: r.n for r in spelling.words_of(docs).collect()} == want


def test_near_pairs_are_all_found_once(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(700)})
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    want = sorted(tuple(sorted(p)) for p in combinations(words, 2) if one_edit(*p))
    assert sorted(tuple(sorted((r.a, r.b))) for r in got.collect()) == want and len(want) > 400


def test_ties_chains_and_roots(spark):
    rows = [("aaaaaaa", 1000), ("aaaaaab", 100), ("aaaaabb", 10), ("aaaabbb", 1)]
    forms = spark.createDataFrame([(w, rows[i - 1][0] if i else None) for i, (w, _) in enumerate(rows)], "word string, form string")
    assert {r.root for r in spelling.rooted(forms).collect()} == {"aaaaaaa"}
    texts = " ".join(["zzzzzza"] * 20 + ["zzzzzzb"] * 20 + ["zzzzzzc"] * 2 + ["yyyyyyy"] * 200 + ["yyyyyyx"] * 20 + ["yyyyyxx"] * 2)
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame([(k, texts) for k in (2, 3, 4)], "doc_id long, text string")).collect()}
    assert got["zzzzzzc"] == ("zzzzzza", "zzzzzza", 2) and got["zzzzzza"] == (None, "zzzzzza", 2)
    assert got["yyyyyxx"] == ("yyyyyyx", "yyyyyyy", 1) and got["yyyyyyx"] == ("yyyyyyy", "yyyyyyy", 2)


@pytest.mark.parametrize("piece", [3, 1000])
def test_long_texts_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    text = "Variants of łvariantsé中 \U0001f600x  longest" * 3
    assert [r.decode("latin-1") for some in spelling.runs(text) for r in some] == [lowered(r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "lettering Lettering", "b"), (5, "lettering 12", "c")], "doc_id long, text string, word string")
    assert [r.word for r in spelling.variants(docs).collect()] == list(counted([tuple(r[:2]) for r in docs.collect()])) == ["lettering"]
    assert spelling.variants(docs.where("false")).collect() == []
