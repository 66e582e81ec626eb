"""Near copies against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from wattscope.llm import catalog, jaccard
from wattscope.llm.components import connected_components


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_links) from strings, all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    near = {(i, j) for own in index.values() for i in own for j in own if i < j}
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        both = len(sets[i] & sets[j])
        if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[top(i)] = top(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(rows[i][0])
    return sorted(((rows[i][0], min(classes[top(i)], key=lambda x: (x is None, x)), links[i]) for i in range(len(rows))), key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as class_id", "2 as band")
    return sorted(map(tuple, jaccard.near_copies(docs, **how).collect()), key=str)


def family(rng, base, copies, edits, first):
    """Copies of a text with a few words changed."""
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_families(spark, monkeypatch, small):
    rng = random.Random(8)
    rows, first = [], 0
    for f in range(12):
        base = [f"w{f}x{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))]
        rows += family(rng, base, rng.choice((1, 2, 5, 40)), 3, first)
        first += 1000
    rows += [(k, rows[0][1].upper() + "!") for k in range(50_000, 50_030)]
    if small:  # every group is cut into many blocks
        monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "two one"), (None, "one two"), (7, long), (8, long + " end"),
            (9, "a b c d e f g h i j"), (9, "a b c d e f g h i j"), (10, "a b c d e f g h i k"), (None, None)]
    rows += [(None, "only here, without an id, of all rows"), (None, "Only here without an id of all rows"), (None, "a b c d e f g h i j")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_chain_is_cut_by_its_bands(spark, monkeypatch):
    """Texts alike only by neighbours hang together all the same: the bands' groups are the pieces."""
    rng = random.Random(3)
    words = [f"c{rng.randrange(10**9)}" for _ in range(2100)]
    rows = [(k, " ".join(words[5 * k:5 * k + 100])) for k in range(400)] + [(None, " ".join(words[:100]))] * 3
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)
    routes, pieces = [], jaccard._pieces
    monkeypatch.setattr(jaccard, "_pieces", lambda *a: routes.append(pieces(*a)) or routes[-1])
    assert run(spark, rows, recall=0.999999) == brute(rows)
    moved = routes[0].selectExpr("min(place) as least", "sum(blocks) as rows").first()
    assert moved["least"] >= 0 and moved["rows"] < 400 * 134


def test_a_pair_is_compared_in_one_band():
    rng = np.random.default_rng(2)
    bands = rng.integers(0, 4, (40, 6))
    times = np.zeros((40, 40), int)
    for place in range(6):
        fresh = jaccard.not_met_before(bands, place)
        times += fresh & (bands[:, place][:, None] == bands[:, place][None, :])
    assert (times == (bands[:, None, :] == bands[None, :, :]).any(axis=2)).all()


@pytest.mark.parametrize("split", [False, True])
def test_a_band_leaves_pairs_that_met_before(split):
    """Three equal sets; the first two met in an earlier band."""
    row = lambda k, band: {"node": bytes([k]), "side": int(split and k == 2), "x": 0, "y": int(split), "times": 1, "place": 1, "bands": [band, 7],
                           "text": "a b c d e f g"}
    got = list(jaccard._verified([row(0, 1), row(1, 1), row(2, 2)], 5, 0.8))
    assert {g[0]: g[1] for g in got if g[2] is None} == {b"\x00": 1, b"\x01": 1, b"\x02": 2}


def test_similar_counts_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    want = {(i, j) for i in range(30) for j in range(i + 1, 30)
            if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*map(list, jaccard.similar(sets, 0.5, columns=7)), strict=True)) == want and want
    assert set(zip(*map(list, jaccard.similar(sets, 0.5, 10)), strict=True)) == {(i, j) for i, j in want if i < 10 <= j}


def test_banding_meets_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        b, r = jaccard.banding(0.8, recall)
        assert 1 - (1 - 0.8 ** r) ** b >= recall and b <= 24
    assert jaccard.banding(0.8, 0.999, rows=3)[1] == 3


def test_sets_are_signed_together_as_each_alone():
    """A band's hash is that of the least values of its rows, whatever other sets are signed with it."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(1 << 64, size=k, dtype=np.uint64) for k in (1, 300, 2, 70, 1)]
    hasher = jaccard.MinHash(4, 3)
    want = []
    for found in sets:
        least = [min((int(x) * int(a) + int(b)) % 2 ** 64 >> 20 for x in found) for a, b in zip(hasher.a, hasher.b, strict=True)]
        out = np.arange(4, dtype=np.uint64)
        for r in range(3):
            out = jaccard.hashing.mix(out + np.array(least[r::3], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        want.append(out.view(np.int64).tolist())
    assert hasher.bands_of(sets).tolist() == want and hasher.bands_of([]).tolist() == []
    assert [hasher.bands_of(s).tolist() for s in jaccard._some(sets, 1)] == [[w] for w in want]
    assert [len(s) for s in jaccard._some([*sets, sets[0][:0]], 302)] == [3, 3]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, catalog.op7_jaccard(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (3, "z"), (None, "q"), (None, "q"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r[0] for r in jaccard.one_of_each(docs).collect()), key=str) == [1, 3, 4, None]
    # Without an id too one of each class stays, and rows that nothing tells apart or together all do.
    rows = [(None, "q r s t u v"), (None, "Q r s t u v!"), (None, "q r s t u v"), (7, "w x"), (None, "w x"), (None, None), (None, None), (None, "..."), (None, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((tuple(r) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert [r for r in left if r[1] in (None, "...", "w x")] == sorted([(None, None)] * 2 + [(None, "...")] * 2 + [(7, "w x")], key=str) and len(left) == 6
    # One doc_id with different texts: two documents, of which one has a copy.
    rows = [(9, "a b c d e f"), (9, "quite another text"), (10, "quite another text"), (8, "A b c d e f!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stays", "2 as text_hash")
    assert sorted(tuple(r)[:2] for r in jaccard.one_of_each(docs).collect()) == [(8, "A b c d e f!"), (9, "quite another text")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert connected_components(edges.where("false")).count() == 0


def test_components_of_a_path_with_names_in_any_order(spark):
    names = random.Random(1).sample(range(10**9), 3000)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = dict(connected_components(edges, most_rounds=15).collect())
    assert got == dict.fromkeys(names, min(names))
