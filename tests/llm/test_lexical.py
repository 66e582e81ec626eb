"""Ranked search against the scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from wattscope.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item in sorted({i for i, t in items if i is not None and t is not None}):
        asked = Counter(terms(min(t for i, t in items if i == item and t is not None)))
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * count // total
            s = sum(x * math.floor(1000 * math.log((2.0 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, row int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    return sorted(map(tuple, lexical.search(d, b, **more).collect()))


@pytest.mark.parametrize("more", [{}, {"shard": 300, "block": 4}, {"k": 3, "shard": 700}])
def test_random_documents(spark, more):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["Über", "élan", "北京"]
    p = (p := 1 / np.arange(1, len(words) + 1)) / p.sum()
    docs = [(i, " ".join(rng.choice(words, p=p, size=int(rng.integers(0, 60))))) for i in range(250)]
    items = [(i, ", ".join(rng.choice(words, p=p, size=int(rng.integers(0, 14))))) for i in range(13)]
    assert run(spark, docs, items, **more) == brute(docs, items, more.get("k", 20))


def test_skipping_keeps_ties_and_repeats(spark):
    docs = [(i, "the the common words " + "rare " * (i % 2)) for i in range(300)] + [(7, "rare the rare"), (7, "rare the rare"), (-5, "the rare rare rare")]
    items = [(1, "the rare the the"), (2, "common common words"), (3, "rare"), (4, "the common words"), (5, "absent"), (6, "THE! the")]
    for shard in (100, 400_000):
        assert run(spark, docs, items, shard=shard) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha"), (3, "alpha"), (3, "alpha beta"), (4, "beta " * 50_000 + "alpha"), (5, "... 12 alpha_b"), (6, "x")]
    items = [(1, "alpha beta"), (1, "zeta"), (None, "alpha"), (2, None), (3, ""), (4, "beta 12 b"), (4, "beta 12 b")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs, [(1, "?")]) == []


def test_a_pair_bound_is_below_the_sum_and_never_below_a_score():
    single, joint = {0: 50, 1: 60}, {(0, 1): 70}
    assert lexical._bound(((0, 1), (1, 1)), single, joint) == 70 and lexical._bound(((0, 1), (1, 1)), single, {}) == 60
    assert lexical._bound(((0, 3), (1, 1)), single, joint) == 170 and lexical._bound(((0, 1),), single, joint) == 50
    assert lexical._bound(((0, 1), (2, 1)), single, joint) == 50


@pytest.mark.parametrize("most_sent", [0, 100])
def test_a_document_moves_as_one_row_of_the_items_terms(spark, most_sent):
    """Terms of no item are dropped where they are counted, or by the join where there are too many to be sent."""
    rows = [(5, "the cat. The dog, THE end"), (6, "nothing asked"), (7, "..."), (8, None), (None, "cat"), (5, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    wanted = spark.createDataFrame([("the", 40), ("cat", 7), ("absent", 3)], "term string, t long")
    held = lexical.postings(docs, wanted, most_sent).collect()
    assert sorted((r["doc_id"], r["n"], sorted(zip(r["t"], r["tf"], strict=True))) for r in held) == [(5, 1, [(7, 1)]), (5, 6, [(7, 1), (40, 3)]), (6, 2, [])]
    items = [(1, "the cat"), (2, "asked nothing dog"), (3, "absent")]
    assert run(spark, rows, items, most_sent=most_sent) == brute(rows, items)


def test_any_character_parts_terms_alike(spark):
    """Documents are split by Arrow, items by Spark."""
    text = "".join(f"a{chr(c)}B" for c in [*range(256), 0x130, 0x212A, 0x2028, 0x3000, 0xFFFD, 0x1F600]) + " é"
    docs = [(1, text), (2, text[::-1]), (3, " " + text.lower() + "\n"), (4, "ab B a é")]
    items = [(k, w) for k, w in enumerate(terms(text))]
    assert run(spark, docs, items) == brute(docs, items)
