import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import learning, quality, toxicity


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 7) for i, t in rows], "doc_id long, text string, lang string, score double, predicted int")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", (0.97, 0.85)), (quality, "quality", (0.99, 0.98))])
def test_held_out_accuracy(tables, module, label, least):
    docs, labels = tables
    scored = module.score(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", label).collect()
    assert all(fold(r.doc_id) == 1 and 0 <= r.score <= 1 for r in rows)
    y, p = np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])
    assert (y == p).mean() > least[0] and p[y == 1].mean() > least[1]


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, tables):
    docs, labels = tables
    few = docs.where("doc_id < 600")
    flipped = labels.withColumn("toxic", F.when(learning.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a = sorted((r.doc_id, r.score) for r in toxicity.score(few, labels).collect())
    b = sorted((r.doc_id, r.score) for r in toxicity.score(few.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source"), flipped).collect())
    assert a == b


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_edges(spark, module, label):
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = [(1, None), (2, ""), (2, ""), (None, "some words"), (3, "word " * 100_000), (4, "é漢 \u0000 ***")]
    got = module.score(frame(spark, rows), empty).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1
    assert {r.doc_id: r.held_out for r in got} == {i: fold(i) == 1 for i, _ in rows}
    assert module.score(frame(spark, []), empty).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(None, 1), (5, None)], f"doc_id long, {label} int")
    docs = [(i, f"bad junk*** thing{i} idiot" if i % 2 else f"a fine text number {i}.") for i in range(1, 200)] + rows
    assert module.score(frame(spark, docs), labels).count() == len(docs)


def test_non_negative_risk_keeps_a_positive_prior():
    rng = np.random.default_rng(0)
    toxic = [np.array([1, 2, *rng.integers(100, 900, 20)], np.int32) for _ in range(200)]
    clean = [rng.integers(100, 900, 22).astype(np.int32) for _ in range(900)]
    weights = toxicity.train(toxic[:100], clean + toxic[100:], 0.1)
    assert weights[1] > 0.5 and weights[2] > 0.5 and weights[-1] < 0
    assert toxicity.train([], clean, 0.1).keys() == {-1}


def test_dual_descent_matches_the_primal():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(30) < 0.3).astype(np.int32) for _ in range(300)]
    y = np.array([1 if (r < 10).sum() > (r >= 20).sum() else -1 for r in rows])
    x = learning.Sparse([np.append(r, 30) for r in rows])
    w = quality.descend(x, y, 31, rounds=300)
    few = [len(y) / (2 * (y == k).sum()) for k in (-1, 1)]
    cost = lambda v: v @ v / 2 + (np.where(y > 0, few[1], few[0]) * np.maximum(0, 1 - y * x.times(v))).sum()
    assert all(cost(w) <= cost(w + rng.normal(0, 0.05, 31)) for _ in range(200)) and cost(w) < cost(np.zeros(31))


def test_accepted_keeps_columns_and_whole_rows(spark, tables):
    docs, labels = tables
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def sample_texts():
    rng = np.random.default_rng(9)
    good = [" ".join(rng.choice(["The", "river", "runs", "slowly,", "past", "old", "mills.", "We", "saw", "42", "boats"], 30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["CLICK", "here!!!", "buy", "buy", "now", "free$$", "xx1", "river", "old"], 25)) for _ in range(60)]
    return good + bad, np.array([1] * 60 + [0] * 60)


def crc(kind, name, bits):
    return zlib.crc32(f"{kind}\t{name}".encode()) % 2**bits


def test_toxicity_equals_a_plain_twin():
    """The same learner with dense rows and loops in place of hashed sparse ones."""
    texts, y = sample_texts()
    def features(text):
        out = []
        for token in set(text.lower().split()):
            word = token.strip("!?.,$*")
            out += [crc("w", word, 20)] + [crc("p", word[:n], 20) for n in (4, 5, 6, 7) if len(word) > n]
        return out
    prior, rows = 0.4, [features(t) for t in texts]
    assert [sorted(r) for r in rows] == [sorted(toxicity.features(t).tolist()) for t in texts]
    p, u = [r for r, k in zip(rows, y, strict=True) if not k], rows
    found = toxicity.train([np.array(r, np.int32) for r in p], [np.array(r, np.int32) for r in u], prior)
    kept = []
    for f in sorted({f for r in p for f in r}):
        a, b = sum(f in r for r in p), sum(f in r for r in u)
        d = (a / len(p) - b / len(u)) / np.sqrt((a + b + 1) / (len(p) + len(u)) * (1 / len(p) + 1 / len(u)))
        kept += [f] * (a >= 3 and a / len(p) > 3 * b / len(u) and d > 3)
    kept = [f for f in kept]
    dense = lambda some: np.array([[r.count(f) for f in kept] + [1] for r in some], float)
    xp, xu, w = dense(p), dense(u), np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 301):
        zp, zu = xp @ w, xu @ w
        loss = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        rest = xu.T @ (1 / (1 + np.exp(-zu))) / len(u) - prior * xp.T @ (1 / (1 + np.exp(-zp))) / len(p)
        g = prior * (xp.T @ (-1 / (1 + np.exp(zp)))) / len(p) + rest if loss >= 0 else -rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.003, 0)
    assert sorted(k for k in found if k >= 0) == kept and found[-1] == pytest.approx(w[-1], abs=1e-6)
    assert [found[f] for f in kept] == pytest.approx(list(w[:-1]), abs=1e-6)
    score = toxicity.Scorer(found).score
    for t in [*texts[::7], "", "plain words"]:
        z = found[-1] + sum(found.get(f, 0) for f in features(t))
        assert score(t) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_quality_equals_a_plain_twin():
    """Ratios, hinge weights, mixture and scores by dictionaries and loops."""
    texts, y = sample_texts()
    order = np.random.default_rng(3).permutation(len(y))
    texts, y = [texts[i] for i in order], y[order]
    of = lambda t: [int(f) for f in quality.Features().of(t)]
    model = quality.train([np.array(of(t), np.int32) for t in texts], y)
    train = [(of(t), 1 if k else -1) for i, (t, k) in enumerate(zip(texts, y, strict=True)) if i % 5]
    count = {}
    for fs, _ in train:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    kept = sorted(f for f, n in count.items() if n >= min(quality.LEAST, max(2, len(train) // 50)) and n < len(train))
    share = lambda k: {f: 1 + sum(f in fs for fs, y_ in train if y_ == k) for f in kept}
    good, bad = share(1), share(-1)
    ratio = {f: np.log(good[f] / sum(good.values()) / (bad[f] / sum(bad.values()))) for f in kept}
    assert model["ids"].tolist() == kept and model["ratio"] == pytest.approx([ratio[f] for f in kept], abs=1e-9)

    def scaled(fs):
        x = {f: ratio[f] for f in fs if f in ratio} | {-1: 1.0}
        n = np.sqrt(sum(v * v for v in x.values()))
        return {f: v / n for f, v in x.items()}

    rows = [(scaled(fs), k) for fs, k in train]
    w, alpha = dict.fromkeys([*kept, -1], 0.0), [0.0] * len(rows)
    most = {k: len(rows) / (2 * sum(y_ == k for _, y_ in rows)) for k in (-1, 1)}
    shuffle = np.random.default_rng(7)
    for _ in range(15):
        moved = 0.0
        for i in shuffle.permutation(len(rows)):
            x, k = rows[i]
            slope = k * sum(w[f] * v for f, v in x.items()) - 1
            new = min(max(alpha[i] - slope / sum(v * v for v in x.values()), 0), most[k])
            for f, v in x.items():
                w[f] += (new - alpha[i]) * k * v
            moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    mean = sum(abs(w[f]) for f in kept) / len(kept)
    want = [mean / 2 + w[f] / 2 for f in kept] + [w[-1]]
    assert model["weights"] == pytest.approx(want, abs=1e-3)
    score = quality.Scorer(model).score
    weight = dict(zip([*kept, -1], model["weights"], strict=True))
    for t in [*texts[::9], "", "unseen"]:
        z = sum(weight[f] * v for f, v in scaled(of(t)).items())
        assert score(t) == pytest.approx(1 / (1 + np.exp(-(model["slope"] * z + model["place"]))), abs=1e-6)
    margins = [(sum(weight[f] * v for f, v in scaled(of(t)).items()), k) for i, (t, k) in enumerate(zip(texts, y, strict=True)) if i % 5 == 0]
    assert np.mean([(model["slope"] * z + model["place"] > 0) == bool(k) for z, k in margins]) == 1


def test_repeated_documents_are_learned_from_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, label int")
    docs = frame(spark, [(i, f"word{i} text") for i in range(1, 60)] * 5 + [(1, "another text")] * 100)
    rows, y = learning.feature_rows(docs, labels, lambda: lambda t: np.array([len(t)], np.int32))
    assert len(rows) == 59 and y.sum() == 30


def test_a_sample_of_many_characters_loses_rows_but_no_part_of_a_text(spark, monkeypatch):
    sizes = [(5, 1, 0, 40), (1, 2, 0, 50), (2, 3, 1, 60), (3, 4, 1, 10), (9, 5, 0, 1)]
    assert learning.affordable(sizes, 100) == [(2, 0), (3, 1)] and learning.affordable(sizes, 1) == [(2, 0), (3, 1)]
    assert len(learning.affordable(sizes, 1000)) == 5
    monkeypatch.setattr(learning, "MOST_CHARACTERS", 3000)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    rows, y = learning.feature_rows(frame(spark, [(i, "x" * 200) for i in range(40)]), labels, lambda: lambda t: np.arange(len(t), dtype=np.int32))
    assert 12 <= len(rows) <= 16 and all(len(r) == 200 for r in rows) and set(y) == {0, 1}
