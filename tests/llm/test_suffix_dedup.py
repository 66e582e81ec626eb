"""Removal of repeats against a count of every window, and the suffix sort against Python's sort."""

import random
from collections import Counter

import numpy as np
import pytest

from wattscope.llm import catalog, hashing, suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = [i for i in range(len(t)) if gone[i] and not (i and gone[i - 1])]
        out.append((key, len(t), sum(gone), len(runs), bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "'x' as z", "2 as k1").repartition(3)
    got = suffix_dedup.remove_repeats(docs, **how).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), bytes(r["kept"])) for r in got), key=str)


def story(rng):
    word = lambda k=400: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) if rng.random() < 0.5 else f"w{rng.randrange(k)}"
    shared = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.3 else " ".join(word(10**9) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 6))]
        rows.append((k, " ".join(parts)))
    rows += [(100 + k, rows[k % 3][1]) for k in range(9)]
    return rows


@pytest.mark.parametrize(("seed", "most_classes"), [(1, 20_000), (2, 2)])
def test_against_every_window(spark, seed, most_classes):
    rows = story(random.Random(seed))
    assert run(spark, rows, length=24, gram=6, most_classes=most_classes) == brute(rows, 24)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    data = story(random.Random(3))[5][1] * 3
    full = [a for a in suffix_dedup.anchors(data.encode(), 24, 6)]
    assert len(full) > 1
    covered = np.concatenate([np.concatenate([np.arange(a, b + 1) for a, b in zip(x[1], x[2], strict=True)]) for x in full])
    assert covered.tolist() == list(range(len(data.encode()) - 23))


def test_odd_rows(spark):
    long = " ".join(f"l{k}" for k in range(30_000))
    passage = "x" * 399
    rows = [(1, None), (2, ""), (3, "short"), (None, passage + "y"), (None, passage + "y"), (4, passage), (5, passage), (6, long), (7, long[50_000:90_000]),
            (8, "a" * 401), (9, "b" * 400), (10, "é" * 200), (11, "é" * 200), (12, "ab" * 500)]
    got = run(spark, rows)
    assert got == brute(rows, 400)
    assert run(spark, []) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, catalog.op9_suffix(spark, "/root/testdata/sf0.001").collect()))
    import hashlib
    assert got == sorted((k, n, m, s, hashlib.sha256(t).hexdigest()) for k, n, m, s, t in brute(rows, 400))


def test_suffix_sort():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 90))) for _ in range(30)]
    s = suffix_dedup.Suffixes(texts, 12, 0)
    owner = np.repeat(np.arange(30), 8)
    at = s.first[owner] + np.tile(np.arange(8), 30)
    bucket = np.sort(np.array([rng.randrange(5) for _ in at]))
    order = s.sort(at, bucket)
    whole = s.bytes.tobytes()
    for k in range(5):
        own = order[bucket == k]
        assert sorted(own) == np.flatnonzero(bucket == k).tolist()
        parts = [whole[at[i]:at[i] + 12] for i in own]
        assert parts == sorted(parts)


def alike():
    """Two different texts of 400 bytes with the same 96-gram as anchor, and equal polynomial hashes whatever the (odd) base:
    their difference is a product of 1 - x^k that is divisible by 2^64."""
    d = np.ones(1, int)
    for step in (*[1] * 8, 4, 8, 16):
        d = np.convolve(d, np.r_[1, np.zeros(step - 1, int), -1])
    heads = np.full((2, 8 * (len(d) - 1) + 1), 32)
    heads[0, ::8] += np.maximum(d, 0)
    heads[1, ::8] += np.maximum(-d, 0)
    rng = random.Random(1)
    while True:
        tail = "".join(rng.choice("cdefghij") for _ in range(400 - heads.shape[1]))
        texts = ["".join(map(chr, h)) + tail for h in heads]
        (at, _, _, g, _), (at2, _, _, g2, _) = (next(suffix_dedup.anchors(t.encode(), 400, 96)) for t in texts)
        if len(at) == len(at2) == 1 and at[0] == at2[0] and g[0] == g2[0]:
            return texts


@pytest.mark.parametrize("most_classes", [20_000, 1])
def test_texts_of_equal_hashes(spark, most_classes):
    one, other = alike()
    assert len({hashing.prefix(np.frombuffer(t.encode(), np.uint8), b)[-1] for t in (one, other) for b in range(3)}) == 3
    rows = [(1, one), (2, other)]
    assert run(spark, rows, most_classes=most_classes) == brute(rows, 400)
    rows = [(1, one), (2, "before " + one), (3, other), (4, other + " behind"), (5, "x" + other)]
    assert run(spark, rows, most_classes=most_classes) == brute(rows, 400)


def test_hot_gram_is_split(spark):
    """The classes of a k-gram that very many have are joined by several tasks."""
    small = {"skewJoin.skewedPartitionThresholdInBytes": "20000", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "20000"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in small} | {"autoBroadcastJoinThreshold": spark.conf.get("spark.sql.autoBroadcastJoinThreshold")}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = "named_struct('k1', id, 'k2', id, 'at', 0, 'lo', 0, 'hi', 0) as one"
        classes = suffix_dedup.materialize(spark.range(0, 30_000, 1, 8).selectExpr("if(id < 20000, 0, id div 2) as g", "cast(string(id) as binary) as c", "1L as n", one), "t")
        got = suffix_dedup.contested(classes)
        rows = got.collect()
        assert len(rows) == 30_000 and {r["classes"] for r in rows} == {2, 20_000}
        assert "SortMergeJoin(skew=true)" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before.pop("autoBroadcastJoinThreshold"))
        for k, v in before.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)


@pytest.mark.parametrize("most_classes", [20_000, 2])
def test_common_passage_is_cut(spark, monkeypatch, most_classes):
    """A passage that very many documents have does not bring them all to one task of the sort."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(k, own(60) + passage + own(60)) for k in range(300) for passage in [" all of them have this line in common " if k % 3 else "this, of 23 bytes, is no"]]
    rows += [(400 + k, rows[k % 2][1][:100]) for k in range(3)]
    biggest, sort = [], suffix_dedup.sorted_windows

    def spy(members, *args):
        biggest.append(max((r["count"] for r in members.groupBy("g").count().collect()), default=0))
        return sort(members, *args)

    monkeypatch.setattr(suffix_dedup, "sorted_windows", spy)
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    assert run(spark, rows, length=24, gram=6, most_classes=most_classes) == brute(rows, 24)
    assert len(biggest) == 2 and max(biggest) <= 16


def test_collisions_are_noticed(monkeypatch):
    members = [(1, 0, 5, b"abcdefghijklmnop"), (1, 0, 5, b"abcdefghijklmnoq"), (1, 0, 5, b"zbcdefghijklmnoq"), (2, 0, 5, b"abcdefghijklmnop")]
    want = [f.tolist() for f in suffix_dedup.repeated_windows(members, 12)]
    assert want == [[True] * 4 + [False], [True] * 5, [False, *[True] * 4], [False] * 5]
    honest = hashing.prefix

    def broken(x, base=0):
        return honest(x // 16 if base == 0 else x, base)

    monkeypatch.setattr(hashing, "prefix", broken)
    assert [f.tolist() for f in suffix_dedup.repeated_windows(members, 12)] == want
    monkeypatch.setattr(hashing, "prefix", lambda x, base=0: honest(x * 0, base))
    with pytest.raises(RuntimeError):
        suffix_dedup.repeated_windows(members, 12)


def test_order_is_verified(monkeypatch):
    """A collision that only spoils the order keeps equal windows apart."""
    class Careless(suffix_dedup.Suffixes):
        def __init__(self, texts, length, base):
            super().__init__(texts, length, base)
            self.careless = base == 0

        def common(self, a, b):
            n = super().common(a, b)
            return np.where(n < self.length, self.length - 1, n) if self.careless else n

    monkeypatch.setattr(suffix_dedup, "Suffixes", Careless)
    members = [(1, 0, 1, b"abcdefghijkl"), (1, 0, 1, b"zbcdefghijkl"), (1, 0, 1, b"abcdefghijkl")]
    assert [f.tolist() for f in suffix_dedup.repeated_windows(members, 12)] == [[True], [False], [True]]


@pytest.mark.parametrize("stretch", [1, 7, 2_000_000])
def test_every_claim_of_a_sort(monkeypatch, stretch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(20)]
    s = suffix_dedup.Suffixes(texts, 12, 0)
    at = np.concatenate([f + np.arange(10) for f in s.first[:-1]])
    at = at[s.sort(at, np.zeros(len(at), int))]
    a, b = at[:-1], at[1:]
    n = s.common(a, b)
    assert (n < 12).any() and (n == 12).any()
    s.verify(a, b, n)
    for k in range(len(n)):
        for wrong in {int(n[k]) - 1, int(n[k]) + 1} & set(range(13)):
            with pytest.raises(suffix_dedup.Collision):
                s.verify(a, b, np.r_[n[:k], wrong, n[k + 1:]])
