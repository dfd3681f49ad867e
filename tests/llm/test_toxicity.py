import random
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import _text as X
from tessella.llm import toxicity


def rows(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmno é") for _ in range(r.randint(2, 7)))
    out = []
    for i in range(n):
        toxic = r.random() < 0.3
        w = [word() for _ in range(r.randint(15, 120))]
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["zorkling", "Zorkful", "quimpish"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_features_match_brute_force(texts):
    own = [t or "" for _, t in texts][:20] + ["Ääß", "ab", "ABCabc"]
    data, off = X.utf8(pa.array(own))
    got = list(toxicity.features(data, off))
    lowered = [t.translate({c: c + 32 for c in [*range(65, 91), *range(192, 215), *range(216, 223)]}) for t in own]
    grams = [{t[i : i + n] for n in toxicity.LENGTHS for i in range(len(t) - n + 1)} for t in lowered]
    for t, f, g in zip(lowered, got, grams, strict=True):
        assert len(set(f.tolist())) == len(f) <= len(g), t
        assert len(f) >= 0.99 * len(g) - 1
    assert sorted(got[-1].tolist()) == sorted(next(iter(toxicity.features(*X.utf8(pa.array(["abcabc"]))))).tolist())


def test_held_out_accuracy(spark):
    table = rows(900, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(10_000, None), (10_001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table] + [(10_000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter(toxicity.fold() != 0))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in table if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95
    assert got[10_000] == got[10_001]


def test_without_both_labels_and_empty(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, none)
    got = toxicity.score(odd_docs, model)
    assert got.columns == [*odd_docs.columns, "score"]
    assert {round(r.score, 6) for r in got.collect()} == {0.5}
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


def test_the_fit_ends_at_a_minimum():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(8, 8)), r.normal(size=8)
    a = a @ a.T + np.eye(8)
    w = toxicity._least(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(8))
    assert np.allclose(a @ w, b, atol=0.05)


def test_fit_matches_a_dense_one(monkeypatch):
    """Ratios, fit and scores of 60 texts against dense matrices; both forms of packed buckets, held or not."""
    table = rows(60, 11)
    label = np.array([y for _, _, y in table])
    found = list(toxicity.features(*X.utf8(pa.array([t for _, t, _ in table]))))
    x = np.zeros((60, toxicity.BUCKETS), np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1
    used = np.flatnonzero(x.sum(axis=0) >= toxicity.LEAST_TEXTS)
    x = x[:, used].astype(np.float64)
    pos, neg = x[label == 1].sum(axis=0), x[label == 0].sum(axis=0)
    ratio = np.log((pos + toxicity.SMOOTHING) / (label.sum() + 1)) - np.log((neg + toxicity.SMOOTHING) / ((1 - label).sum() + 1))
    z, sign, mean = x * ratio, 2.0 * label - 1, x.sum() / 60

    def loss(w):
        m = sign * (z @ w[:-1] + w[-1])
        g = -sign / (1 + np.exp(m)) / 60
        back = np.append(z.T @ g + 2 * toxicity.PENALTY / mean * w[:-1], g.sum())
        return np.logaddexp(0, -m).mean() + toxicity.PENALTY / mean * (w[:-1] ** 2).sum(), back

    w = toxicity._least(loss, np.zeros(len(used) + 1))
    want = z @ w[:-1] + w[-1] - np.log(label.sum() / (1 - label).sum()) + np.log(0.2 / 0.8)
    dense = [np.packbits(np.isin(np.arange(toxicity.BUCKETS), f)).tobytes() for f in found]
    for packed, most in (([toxicity.packed(f) for f in found], 10**9), (dense, 10**9), (dense, 0)):
        monkeypatch.setattr(toxicity, "HELD", most)
        monkeypatch.setattr(toxicity, "PART", 3000)
        weight, intercept = toxicity.fit(packed, label, 0.2)
        assert np.allclose([weight[f].sum() + intercept for f in found], want, atol=1e-3)
        assert set(np.flatnonzero(weight)) <= set(used.tolist())


def test_labels_that_disagree_or_have_no_text(spark):
    table = rows(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string")
    first = [(i, y) for i, _, y in table]
    noise = [(i, 0) for i, _, y in table if y] + [(10**6 + i, i % 2) for i in range(300)]
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int").repartition(n), sample=150) for x, n in ((first, 1), (first + noise, 3), (noise + first, 2))]
    for weight, intercept in models[1:]:
        assert np.array_equal(weight, models[0][0]) and intercept == models[0][1]


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a text", "own")], "doc_id long, text string, score string")
    got = toxicity.score(docs, (np.zeros(toxicity.BUCKETS), 0.0))
    assert got.columns == ["doc_id", "text", "score", "score_"] and got.first().score == "own"
