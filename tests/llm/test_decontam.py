"""Winnowing against a search for every window, and the guarantee for shared spans."""

import random
import re

import pytest

from wattscope.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for key, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item, t in items:
            b = tokens(t)
            n = min(window, len(b))
            if item is None or not n:
                continue
            grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        out.append((key, len(w), tuple(sorted(hit)), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as words", "2 as item_id", "3 as contamination")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'y' as words")
    got = decontam.mark(docs, items, **how)
    assert set(docs.columns) == set(got.columns)
    return sorted(((r["doc_id"], r["contamination"]["n_words"], tuple(sorted(r["contamination"]["positions"])),
                    tuple(r["contamination"]["items"]), r["bad"]) for r in got.withColumn("bad", decontam.is_contaminated()).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40), rng.choice((2, 8)))) for i in range(25)] + [(7, "É é  a-b.C" * 4)]
    docs = [(k, text(rng.randrange(0, 150), rng.choice((1, 2, 8)))) for k in range(40)]
    docs += [(100 + i, f"{text(9, 8)}! {t.upper()}; {text(300, 8)}") for i, t in items]
    assert run(spark, docs, items) == brute(docs, items)


def test_every_shared_span_is_found(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    docs = []
    for i, t in items:
        n, at = rng.choice((12, 13, 14, 30)), rng.randrange(0, 30)
        w = [word() for _ in range(80)]
        w[20:20] = t.split()[at:at + n]
        docs.append((i, ", ".join(w)))
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert sum(bool(r[2]) for r in got) == sum(bool(r[2]) for r in brute(docs, items)) > 10


def test_odd_rows(spark):
    long = "tok " * 90_000
    passage = " ".join(f"p{k}" for k in range(20))
    items = [(1, passage), (1, passage), (2, passage), (3, None), (4, ""), (None, passage), (5, "...")]
    docs = [(1, None), (2, ""), (3, long + passage), (None, passage), (4, passage), (4, passage), (None, "x"), (5, passage.replace(" ", "\n\t"))]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_other_lengths(spark):
    docs, items = [(1, "a b c d e f g h"), (2, "x b c d e y")], [(1, "z a b c d e q"), (2, "c d")]
    assert run(spark, docs, items, window=5, gram=2) == brute(docs, items, 5)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = decontam.mark(docs, docs.selectExpr("doc_id item_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_without_doc_id_are_no_one_group(spark):
    item = lambda k: " ".join(f"w{k}x{i}" for i in range(14))
    docs = [(None, f"{item(k)} tail {k}") for k in range(20)] * 2 + [(None, None), (7, item(3))]
    items = [(k, item(k)) for k in range(20)]
    assert run(spark, docs, items) == brute(docs, items)
    marked = decontam.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert re.search(r"Aggregate \[_k1#\d+L, _k2#\d+L\], .*collect_list", marked._jdf.queryExecution().optimizedPlan().toString())
