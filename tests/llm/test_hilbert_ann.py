"""Neighbours found along Hilbert curves against a scan of all vectors."""

import math

import numpy as np
import pytest

from wattscope.llm import catalog, hilbert_ann


def brute(rows, k):
    ok = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        best = {}
        for i, v in ok:
            if i != q:
                for own in (o for j, o in ok if j == q):
                    n = max(len(own), len(v))
                    a, b = (np.pad(np.array(x), (0, n - len(x))) for x in (own, v))
                    best[i] = min(best.get(i, math.inf), math.sqrt(((a - b) ** 2).sum()))
        out[q] = sorted((s, i) for i, s in best.items())[:k]
    return out


def run(spark, rows, k=10, **more):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, node string, score double").repartition(4)
    got = {}
    for r in sorted(hilbert_ann.search(df, df["vec_id"] % 100 == 0, k=k, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    return got


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def near(got, want):
    return got.keys() == want.keys() and all([i for _, i in got[q]] == [i for _, i in w] and np.allclose([s for s, _ in got[q]], [s for s, _ in w], rtol=1e-12) for q, w in want.items())


@pytest.mark.parametrize(("dims", "bits"), [(2, 5), (3, 4), (5, 2), (1, 6)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hilbert_ann.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_structured_vectors_need_a_small_window(spark):
    rng = np.random.default_rng(2)
    hubs = rng.normal(size=(60, 24))
    m = (hubs[rng.integers(60, size=3000)] + 0.05 * rng.normal(size=(3000, 24))).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    want = brute(rows, 10)
    got = run(spark, rows, curves=8)
    assert recall(got, want) >= 0.93
    exact = {(q, i): s for q, w in brute(rows, 3000).items() for s, i in w}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q, g in got.items() for s, i in g)
    assert recall(run(spark, rows, curves=8, window=40), want) >= 0.9
    assert near(run(spark, rows, curves=2, window=3000, block=500), want)


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, -0.5] if i % 3 else [float(i % 11) + 1, float(i % 7), 3.0]) for i in range(900)]
    assert near(run(spark, rows, window=2000), brute(rows, 10))
    same = [(i, [0.5, 0.5]) for i in range(500)]
    assert near(run(spark, same), brute(same, 10))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, []), (7, [1.0, 1.0, 9.0]),
            (7, [1.0, 1.0, 9.0]), (100, [2.0, 2.0]), (100, [1.0, 9.0]), (8, [-1.0, -1.0]), (9, [0.0, -0.0]), (10, [3e38, -3e38]), (200, [-0.0, 1.0]), (11, [0.0, 1.0]), (300, None)]
    assert near(run(spark, rows), brute(rows, 10))
    for few in ([], [(1, [1.0])], [(100, [1.0])], [(100, None), (1, [2.0])]):
        assert run(spark, few) == {}
    assert near(run(spark, [(100, [1.0]), (3, [2.0])]), {100: [(1.0, 3)]})


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in sorted(catalog.queries()["op12_ann"](spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute(rows, 10)
    assert recall(got, want) >= 0.92 and all(len(g) == 10 for g in got.values()) and got.keys() == want.keys()
