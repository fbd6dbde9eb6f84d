import hashlib

import numpy as np
import pytest
import xxhash

from symgraph.llm import parsing


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, part string, role int, place int")


def plain_level(names):
    """One level on one text, symbol by symbol."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    u = lambda x: np.array([x & (2**64 - 1)], np.uint64)
    seq = [x if n == 1 else int(parsing.mixed(u(x + n * 0x2545F4914F6CDD1D))[0]) for x, n in runs]

    if not seq:
        return [], []

    def toss(s, top):
        out = []
        for i, x in enumerate(s):
            d = x ^ s[i - 1] if i else x | top
            k = (d & -d).bit_length() - 1
            out.append(2 * k + (x >> k & 1))
        return out

    labels = toss(seq, 1 << 63)
    for _ in range(3):
        labels = toss(labels, 0x80)
    begins = [i for i in range(len(seq)) if i == 0 or 0 < i < len(seq) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    w = parsing.weights()
    out = []
    for a, b in zip(begins, begins[1:] + [len(seq)], strict=True):
        total = sum(seq[a + j] * int(w[j & 63]) for j in range(b - a)) + b - a
        out.append(int(parsing.mixed(u(total))[0]))
    return out, labels


def test_levels_equal_a_plain_parse():
    rng = np.random.default_rng(1)
    texts = ["", "a", "aaaa", "ab", "abcabcabc" * 20, "é漢" * 50, "".join(rng.choice(list("abcd "), 3000))]
    for t in texts:
        names = [int(x) for x in parsing.mixed(np.array([ord(c) + 1 for c in t], np.uint64))]
        got, at = np.array(names, np.uint64), np.zeros(len(names), int)
        for _ in range(3):
            want, labels = plain_level(names)
            got, at = parsing.level(got, at, 1)
            assert got.tolist() == want and all(x < 6 for x in labels)
            names = want


def test_equal_substrings_share_their_interior():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    inner = " ".join(words)
    for depth in (1, 2, 3):
        found = []
        for text in (inner, "x" + inner, "quite another beginning " + inner + " and end"):
            names, at = parsing.mixed(np.array([ord(c) + 1 for c in text], np.uint64)), np.zeros(len(text), int)
            for _ in range(depth):
                names, at = parsing.level(names, at, 1)
            found.append(names.tolist())
        for other in found[1:]:
            assert len(set(found[0]) & set(other)) >= len(set(found[0])) - 12


def test_batches_do_not_mix_texts():
    texts = ["abc abd abe", "", "abc abd abe", "zz" * 300, "lorem ipsum dolor sit amet " * 40]
    together = parsing.batches_of(texts)
    for i, t in enumerate(texts):
        assert (parsing.fingerprints([t])[0] == together[i]).all()
    assert parsing.likeness(together[0], together[2]) == 1 and parsing.likeness(together[3], together[4]) < 0.1 and not together[1].any()


def by_hash(text):
    """What rows of one id are ordered by: the text's hash as a signed number, and the text."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (h >> 63 << 64), text or ""


@pytest.mark.parametrize("rows_a_part", [3, 1024])
def test_compare_equals_brute_force(spark, rows_a_part, monkeypatch):
    monkeypatch.setattr(parsing.in_order, "__defaults__", (rows_a_part, 1 << 16))
    rows = [(r.doc_id * 3 - 50, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**12, None), (10**12 + 1, ""), (7, "tie b"), (7, "tie a"), (7, "tie a"), (None, "no id at all"), (10**12 + 5, "w " * 90_000)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), *by_hash(r[1])))
    marks = parsing.batches_of([t or "" for _, t in order])
    want = []
    for i, (d, t) in enumerate(order):
        j = (i + 1) % len(order)
        e = parsing.edited(t or "", order[j][1] or "")
        m = parsing.fingerprints([e])[0]
        want.append((d, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), marks[i].tobytes().hex(), m.tobytes().hex(), round(float(parsing.likeness(marks[i], m)), 9), round(float(parsing.likeness(marks[i], marks[j])), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in parsing.compare(frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5, None], [-(2**62) - 5, 2**62 + 7, 3], [*range(3000), 2**60]])
def test_ids_of_any_size(spark, ids):
    rows = [(d, f"text of {d} " * 3) for d in ids]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {d: hashlib.sha256(parsing.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (d, t) in enumerate(order)}
    assert {r.doc_id: r.edited_sha256 for r in parsing.compare(frame(spark, rows)).collect()} == want


def test_an_outlying_id_leaves_parts_even(spark):
    ids = [*range(20_000), 2**60, -(2**60)]
    sizes = parsing.in_order(frame(spark, [(i, "x") for i in ids])).where("role = 0").groupBy("part").count().collect()
    assert len(sizes) >= 18 and max(r["count"] for r in sizes) < 2_500 and sum(r["count"] for r in sizes) == len(ids)


@pytest.mark.parametrize("texts", [[f"text {i}" for i in range(15_000)], ["one text"] * 15_000])
def test_a_frequent_id_is_several_parts(spark, texts):
    rows = [(None, t) for t in texts] + [(i, f"own {i}") for i in range(4_000)] + [(-5, f"less {i % 700}") for i in range(1_000)]
    found = parsing.in_order(frame(spark, rows).repartition(7), 1024).cache()
    sizes = {r.part: r["count"] for r in found.where("role = 0").groupBy("part").count().collect()}
    assert max(sizes.values()) <= 2_048 and sum(sizes.values()) == len(rows)
    assert found.where("role = 1").count() == len(sizes)
    ordered = sorted(((r.doc_id is None, -(r.doc_id or 0), *by_hash(r.text), r.part) for r in found.where("role = 0").collect()))
    assert [r[-1] for r in ordered] == sorted(r[-1] for r in ordered)
    heads = {r.part: (r.doc_id, r.text) for r in found.where("role = 1").collect()}
    parts = sorted(sizes)
    first = {}
    for none, less, _, text, part in ordered:
        first.setdefault(part, (None if none else -less, text))
    assert heads == {parts[i - 1]: first[p] for i, p in enumerate(parts)}


def test_compare_small_tables(spark):
    assert parsing.compare(frame(spark, [])).count() == 0
    (one,) = parsing.compare(frame(spark, [(5, "abcdef")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1
    (none,) = parsing.compare(frame(spark, [(None, None)])).collect()
    assert none.n_chars == 0 and none.near_edited == 1


def test_edits_stay_near_and_others_far(spark):
    rows = parsing.compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars > 400").collect()
    edited, following = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert (edited > following).mean() > 0.98 and np.median(edited) > 0.25 and np.median(following) < 0.05
