"""Spelling variants against a plain search of all neighbours."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wattscope.llm import catalog, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzßàéñöü"


def vocabulary(rows, least=5):
    count = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = vocabulary(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    return sorted(map(tuple, spelling.variants(docs).collect()))


def test_documents_with_typos(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list(LETTERS), size=int(rng.integers(5, 10)))) for _ in range(60)]
    base += [w[:i] + x + w[i + 1:] for w in base[:20] for i, x in ((0, "q"), (3, "é"), (len(w) - 1, "w"))] + [w[:2] + "k" + w[2:] for w in base[:20]]
    rows = [(k if k % 9 else None, " ".join(rng.choice(base, p=(p := 1 / np.arange(1, len(base) + 1)) / p.sum(), size=400)).title()) for k in range(30)]
    want = brute(rows)
    assert run(spark, rows) == want and sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize(("page", "part"), [(2048, 4096), (1, 3), (7, 2)])
def test_all_pairs_whatever_the_pages(spark, page, part):
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("abé"), size=int(rng.integers(6, 9)))) for _ in range(250)} | {"x" * 70 + "y" * k + "z" * 60 for k in range(3)}
    words |= {"a" * 3000 + t for t in ("b", "c", "cb", "bb")}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    n = {w: i for i, w in enumerate(sorted(words))}
    got = [tuple(r) for r in spelling.near_words(df, page, part).collect()]
    assert sorted(got) == sorted((a, b, n[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_apart(a, b))


def test_a_chain_of_forms_and_ties(spark):
    rows = [(1, " ".join(["garden"] * 5 + ["gardene"] * 25 + ["gardenes"] * 125 + ["gardenis"] * 625 + ["abcdefg"] * 5 + ["abcdefx"] * 30 + ["abcdefd"] * 30))]
    got = {r[0]: r for r in run(spark, rows)}
    assert got == {r[0]: r for r in brute(rows)}
    assert got["garden"][1:3] == ("gardene", "gardenis") and got["abcdefg"][1] == "abcdefd"


def test_odd_rows(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdef"), size=30_000))
    rows = [(1, None), (2, ""), (None, "twelve twelve"), (3, f"{long} {long}y "), (3, f"{long} {long}y "), (4, f"{long}y {long}x " * 3), (5, f"{long} {long}x {long} {long}x"), (6, "ÀÉÏÖÜ× àéïöü÷ " * 9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, "a b c")]) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.queries()["op11_spelling"](spark, d).collect())) == brute(rows)
