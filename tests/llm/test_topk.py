"""Histogram selection against a sort of all scores."""

import math

import numpy as np
import pytest

from wattscope.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min(v for i, v in ok if i == q)
        scores = [(-max(-topk.HIGH, min(topk.HIGH, sum(a * b for a, b in zip(v, c, strict=False)))), i) for i, c in ok if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, rows, k=10, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as v").repartition(5)
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    return sorted(map(tuple, topk.top_k(vectors, vectors["vec_id"] % 100 == 0, k, **more).collect()))


@pytest.mark.parametrize("block", [2, 2048])
def test_random(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(450)]
    assert run(spark, rows, block=block) == brute(rows, 10)


def test_ties_and_hot_vector(spark):
    rows = [(i, [0.5, -0.25] if i % 3 else [1.0, float(i % 7)]) for i in range(-300, 400)]
    assert run(spark, rows) == brute(rows, 10)
    zeros = [(i, [0.0, 0.0]) for i in range(300)]
    assert run(spark, zeros, 3) == brute(zeros, 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (5, [3.0]), (6, []), (7, [1.0, 1.0, 9.0]), (7, [1.0, 1.0, 9.0]), (100, [2.0, 2.0]), (100, [1.0, 9.0]), (8, [-1.0, -1.0])]
    assert run(spark, rows) == brute(rows, 10)


def test_huge_components(spark):
    rows = [(i, [3e38 * (-1) ** i, 1e30, float(i)]) for i in range(12)] + [(200, [1e12, 5.0, 1.0]), (201, [1e13, 0.5, 0.25])]
    held = [(i, [max(-topk.HIGH - 1, min(topk.HIGH, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, v in rows]
    got = run(spark, rows, 4)
    for q, v in held:
        if q % 100 == 0:
            want = sorted((-max(-topk.HIGH, min(topk.HIGH, sum(a * b for a, b in zip(v, c, strict=True)))), i) for i, c in held if i != q)[:4]
            assert [(i, -s) for _, _, i, s in [r for r in got if r[0] == q]] == [(i, s) for s, i in want]


def test_no_queries(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == [] and run(spark, [(100, [1.0])]) == []
