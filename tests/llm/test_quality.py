"""Held-out accuracy, gradients, features, and odd rows."""

import math

import numpy as np
import pytest

from wattscope.llm import catalog, quality


def test_held_out_accuracy(spark):
    got = catalog.op3_quality(spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    low = [1 - r["predicted"] for r in rows if r["quality"] == 0]
    assert len(rows) > 1000 and np.mean(right) > 0.98 and np.mean(clean) > 0.99 and np.mean(low) > 0.9


def test_gradient():
    rng = np.random.default_rng(1)
    model = quality.GatedAttention(5, 4, 3)
    x, first, y, weight = rng.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.forward(x, first)["score"]
        return float(np.mean(weight * -(y * np.log(s) + (1 - y) * np.log(1 - s))))

    grad = model.gradient(model.forward(x, first), first, y, weight)
    for k, p in model.p.items():
        flat = np.atleast_1d(p).reshape(-1)
        for i in range(min(3, flat.size)):
            saved = p.copy() if p.shape else p
            delta = np.zeros(flat.size)
            delta[i] = 1e-6
            model.p[k] = saved + delta.reshape(p.shape)
            up = loss()
            model.p[k] = saved - delta.reshape(p.shape)
            down = loss()
            model.p[k] = saved
            assert (up - down) / 2e-6 == pytest.approx(np.atleast_1d(grad[k]).reshape(-1)[i], abs=1e-5)


def test_attention_finds_the_passage_that_matters():
    """One passage of a bag decides its label; attention must prefer it."""
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(rng.integers(2, 9), 6)) for _ in range(600)]
    y = np.arange(600) % 2.0
    for b, t in zip(bags, y, strict=True):
        b[:, 0] = 0
        b[rng.integers(len(b)), 0] = 3 if t else -3
    model = quality.GatedAttention(6, 8, 4)
    first = np.cumsum([0, *(len(b) for b in bags[:-1])])
    model.fit(np.concatenate(bags), first, y, np.ones(600), epochs=60)
    f = model.forward(np.concatenate(bags), first)
    assert np.mean((f["score"] > 0.5) == y) > 0.95
    marked = np.abs(np.concatenate(bags)[:, 0]) == 3
    assert f["a"][marked].mean() > 2 * f["a"][~marked].mean()


def test_passages():
    assert quality.passages(None).shape == quality.passages(" \n").shape == (1, quality.FEATURES)
    assert not quality.passages("").any()
    x = quality.passages("word " * 65)
    assert x.shape[0] == 2 and x[0, 0] == pytest.approx(0.8) and x[0, -6] > 0.9
    assert quality.passages("a").shape == (1, quality.FEATURES)


LABELS = "doc_id long, quality int, toxic int"


def test_odd_rows(spark):
    good, bad = "Plain words of some length make a sentence.", "### $$$ BUY!! NOW!! ### $$$"
    rows = [(k, good if k % 2 else bad) for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, good), (100, None), (101, ""), (102, good * 9000), (1, good)],
                                 "doc_id long, text string").selectExpr("*", "'x' as score", "1 as target", "2 as quality")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 1), (5, None, 0), (7, 0, 0), (99, 1, 0)], LABELS)
    model = quality.fit(docs, labels)
    got = quality.judged(docs.select("doc_id", "text", "score"), model).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["text"] != bad) for r in got if r["text"] and len(r["text"]) < 99)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101)}) == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, 0, 0), (1, 1, 0)], 0.5)])
def test_nothing_to_learn(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    assert [r["score"] for r in quality.judged(docs, model).collect()] == [score] * 2
    assert quality.judged(docs.where("false"), model).count() == 0


def test_scores_of_a_fitted_model_by_a_plain_forward_pass(spark):
    """Passage by passage, number by number, from the parameters that fitting has left."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    p = {k: np.asarray(v).tolist() for k, v in model.p.items()}
    dot = lambda x, m: [sum(a * row[j] for a, row in zip(x, m, strict=True)) for j in range(len(m[0]))]
    some = docs.orderBy("doc_id").limit(12)
    got = {r["doc_id"]: r["score"] for r in quality.judged(some, model).collect()}
    for r in some.collect():
        weights, encoded = [], []
        for x in quality.passages(r["text"]):
            x = [max(-5.0, min(5.0, (a - m) / s)) for a, m, s in zip(x.tolist(), model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(a + b) for a, b in zip(dot(x, p["W"]), p["d"], strict=True)]
            gate = [1 / (1 + math.exp(-a)) for a in dot(h, p["U"])]
            weights.append(math.exp(sum(math.tanh(a) * g * w for a, g, w in zip(dot(h, p["V"]), gate, p["w"], strict=True))))
            encoded.append(h)
        z = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(encoded[0]))]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-sum(a * c for a, c in zip(z, p["c"], strict=True)) - p["b"])), abs=1e-6)


def test_whole_bags_or_none(spark, monkeypatch):
    """A text over the budget of words is not learned from; what is, is with all its passages."""
    seen = []
    monkeypatch.setattr(quality.GatedAttention, "fit", lambda self, x, first, y, weight: seen.append(np.diff([*first, len(x)]).tolist()))
    docs = spark.createDataFrame([(k, "word " * (64 * (k + 1))) for k in range(6)] + [(9, "word " * 64_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)], LABELS)
    quality.fit(docs, labels, fit_words=10_000)
    assert sorted(seen[0]) == [1, 2, 3, 4, 5, 6]
