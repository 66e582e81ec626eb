"""Base spans against Python's patterns, terms against a count by hand."""

import math
import random
import re
from collections import Counter, defaultdict
from statistics import NormalDist

import pytest

from wattscope.llm import catalog, pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d)
                    or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def risky_terms(texts, threshold=0.9, support=3, confidence=0.9):
    """{term: replacement}"""
    split = lambda t: [w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) >= 3]
    vocabulary, w, n, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        vocabulary.update(split(t or ""))
        found = {k: [s for s in [(m.start(), m.end()) for m in re.finditer(p, t or "")]] for k, p in BASE.items()}
        for kind, a, b in base(t):
            own = found[kind]
            i = own.index((a, b))
            left, right = t[own[i - 1][1] if i else 0:a][-120:], t[b:own[i + 1][0] if i + 1 < len(own) else len(t)][:120]
            key = (left, right)
            left = re.sub(r"^[^\W\d_]+", "", left) if len(left) == 120 else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == 120 else right
            value = re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()
            terms = set(split(left)[-8:] + split(right)[:8])
            w[kind, value] += len(terms)
            for x in terms:
                n[(kind, value), x] += 1
                contexts[(kind, value), x].add(key)
    total = sum(vocabulary.values()) or 1

    z = confidence and NormalDist().inv_cdf(confidence)

    def disclosure(e, near, every, surely=False):
        ic, p = -math.log2(w[e] / total), min(near / every, 1)
        if surely:
            p = (p + z * z / (2 * every) - z * math.sqrt(p * (1 - p) / every + z * z / (4 * every * every))) / (1 + z * z / every)
        return 1 + math.log2(p) / ic if ic > 0 else 0

    out = {}
    for (e, x), k in n.items():
        enough = len(contexts[e, x]) >= support or confidence and disclosure(e, k, vocabulary[x], True) >= threshold
        if enough and disclosure(e, k, vocabulary[x]) >= threshold:
            near = sum(v for (f, y), v in n.items() if f == e and y[:3] == x[:3])
            every = sum(v for y, v in vocabulary.items() if y[:3] == x[:3])
            remove = len(x) <= 3 or disclosure(e, near, every) >= threshold
            out[x] = pii.REMOVED if remove or out.get(x) == pii.REMOVED else x[:3] + "*"
    return out


def spans(text, terms):
    known = base(text)
    if terms:
        p = r"(?<![^\W\d_])(?:" + "|".join(sorted(terms)) + r")(?![^\W\d_])"
        known = known + [("term", m.start(), m.end()) for m in re.finditer(p, text or "", re.I)
                         if not any(a < m.end() and m.start() < b for _, a, b in known)]
    return known


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as term", "'x' as pii", "2 as start")
    got = pii.find(docs, **how)
    return got.withColumn("clean", pii.sanitised(got["text"], got["pii"]))


def check(spark, rows, **how):
    terms = risky_terms([t for _, t in rows], **how)
    got = sorted(((r["doc_id"], r["text"], [tuple(s)[:3] for s in r["pii"]]) for r in run(spark, rows, **how).collect()), key=str)
    assert got == sorted(((k, t, spans(t, terms)) for k, t in rows), key=str)
    return terms


PARTS = ["a@b.c", "@", ".", "a", "1", "255", "256", "0001", "1.2.3.4", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "x_y%z+q", "é", "🙂", "\n",
         "+44 (0) 20-7946.0958", "b.c_x@d.e", "\ue000", "..", "9" * 16, "4111111111111111"]


def test_base_spans(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))) for k in range(800)]
    check(spark, rows, support=10**6, confidence=None)


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(9)
    filler = [f"{a}{b}{c}" for a in ("ban", "cor", "del", "mir") for b in "aeiou" for c in ("ta", "ro", "lin")]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, text(60)) for k in range(60)]
    rows += [(100 + k, f"{text(9)} call Zephyrine or Mirabelle at +49 30 12345678, {text(20)}") for k in range(8)]
    rows += [(200 + k, f"{text(20)} zephyrine, {text(3)} jo@mail.example.org") for k in range(2)]
    terms = check(spark, rows)
    assert terms["zephyrine"] == pii.REMOVED and terms["mirabelle"] == "mir*"
    clean = {r["doc_id"]: r["clean"] for r in run(spark, rows).collect()}
    assert "Zephyrine" not in clean[100] and "[TERM] or mir* at [PHONE]," in clean[100] and "[EMAIL]" in clean[200]
    assert clean[5] == rows[5][1]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (None, "a@b.cd"), (3, "1" * 6_000), (4, "a.b" * 3_000), (5, "x@y" + ".z" * 30_000),
            (6, "1.2.3.4 " * 3000 + "end"), (6, "dup"), (7, "+1" + "(" * 30_000 + "234567890"), (8, "plain é text")]
    check(spark, rows)
    clean = {r["text"]: r["clean"] for r in run(spark, rows).collect()}
    assert clean["a@b.cd"] == "[EMAIL]" and clean["plain é text"] == "plain é text" and clean[rows[7][1]] == "[IP] " * 3000 + "end"
    assert run(spark, []).count() == 0


def test_overlapping_spans_are_replaced_once(spark):
    row = run(spark, [(1, "see a.1.2.3.4@b.cd and 4111111111111111 x")]).first()
    assert [s[0] for s in row["pii"]] == ["email", "ip", "card"] and row["clean"] == "see [EMAIL] and [CARD] x"


def test_query_and_plan(spark):
    got = catalog.op4_pii(spark, "/root/testdata/sf0.001")
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    terms = risky_terms(texts.values())
    for r in got.collect():
        want = spans(texts[r["doc_id"]], terms)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


@pytest.mark.parametrize("sizes", [[], [3], [1] * 700, list(range(600))])
def test_running_starts(spark, sizes):
    from pyspark.sql import functions as F

    from wattscope.llm.native import running_starts
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(running_starts(F.col("s"))).first()[0] == [sum(sizes[:i]) for i in range(len(sizes))]
