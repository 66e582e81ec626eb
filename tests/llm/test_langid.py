"""Held-out accuracy, the bit-sliced table against plain sets, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattscope.llm import catalog, langid


def test_held_out_accuracy(spark):
    got = catalog.op1_langid(spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 200 < len(held) < 300
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_are_those_of_words():
    def plain(text):
        out = set()
        for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
            w = f" {w} "
            out |= {w[i:i + n] for n in langid.ORDERS for i in range(len(w) - n + 1)}
        return out
    for text in ("a", "Ab, cd!", "  été 12x", "one\ntwo  three.", "ÀB"):
        assert len(np.unique(langid.ngrams(text))) == len(plain(text)), text
        words = text.split()
        if len(words) > 1:
            assert set(langid.ngrams(text)) == set(np.concatenate([langid.ngrams(w) for w in words]))
    assert len(langid.ngrams("12 ,.")) == 0


ROWS = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund ist in dem haus", "de")] * 4)]


def test_filters_hold_every_ngram(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    for _, text, lang in ROWS:
        bit = model["langs"].index(lang)
        mask = np.bitwise_and.reduce([model["table"][at] for at in langid._places(langid.ngrams(text))])
        assert (mask >> bit & 1).all()
    assert all(0 < f < 1e-6 for f in model["false_positive"])


def test_odd_rows(spark):
    docs = spark.createDataFrame([*ROWS, (90, None, "en"), (91, "", "en"), (92, "12 34", None), (None, "the cat", None),
                                  (93, "der hund " * 50_000, None), (93, "der hund", None), (93, "der hund", None)],
                                 "doc_id long, text string, lang string").withColumn("score", F.lit(7))
    model = langid.fit(docs, F.lit(True))
    got = sorted(map(str, ((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in
                 langid.predict(docs.select("doc_id", F.col("text").alias("_text")), model).where("doc_id > 50 or doc_id is null").collect())))
    assert got == sorted(map(str, [(90, "und", 0.0), (91, "und", 0.0), (92, "und", 0.0), (None, "en", 1.0), *[(93, "de", 1.0)] * 3]))


@pytest.mark.parametrize("rows", [[], [(1, "text", None)], [(1, None, "en")]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    got = langid.predict(docs.select("doc_id", F.col("text").alias("_text")), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * len(rows)


def test_every_language_beyond_one_mask(spark):
    word = lambda k: "".join(chr(0x4E00 + 40 * k + j) for j in range(30))
    rows = [(n * 1000 + k, word(k), f"l{k:03}") for k in range(130) for n in range(2 if k < 70 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert len(model["langs"]) == len(model["false_positive"]) == 130
    got = langid.predict(docs.select("doc_id", "lang", F.col("text").alias("_text")), model).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] == 1 for r in got)
