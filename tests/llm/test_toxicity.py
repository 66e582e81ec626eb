"""Held-out accuracy, the effect of counterfactual pairs, and odd rows."""

import math
import random

import numpy as np
import pytest

from wattscope.llm import catalog, toxicity


def test_held_out_accuracy(spark):
    got = catalog.op6_toxicity(spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(rows) > 1000 and np.mean(caught) > 0.9 and np.mean(clean) < 0.01


def story():
    """Insults are toxic; 'gay' stands in most toxic sentences of the sample by accident, and in neutral ones."""
    rng, rows, labels = np.random.default_rng(4), [], []
    plain = ["walks", "reads", "sings", "cooks", "paints", "runs", "sleeps", "writes", "plays", "talks"]
    for k in range(600):
        toxic = k % 3 == 0
        who = "gay" if rng.random() < (0.9 if toxic else 0.1) else "straight"
        words = [str(rng.choice(plain)) for _ in range(6)] + [str(rng.choice(["vileword", "badword"]))] * (toxic and rng.random() < 0.9)
        rows.append((k, f"My {who} neighbour {' '.join(words)}."))
        labels.append((k, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_swapping_takes_the_weight_off_identity_terms(spark):
    rows, labels = story()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    neutral = ["My gay neighbour reads.", "The gay choir sings and plays."]
    plain = toxicity.Scorer(toxicity.fit(docs, labels, counterfactual=0.0))
    fair = toxicity.Scorer(toxicity.fit(docs, labels))
    other = [t.replace("gay", "lesbian") for t in neutral]
    for a, b in zip(neutral, other, strict=True):
        assert abs(fair(a) - fair(b)) < 0.1 < abs(plain(a) - plain(b))
        assert fair(a) < plain(a) and fair(a) < 0.5
    assert fair("My straight neighbour reads, that badword.") > 0.7


def test_pairs_name_what_changes():
    following = {"women": "men", "men": "women"}
    assert toxicity.swapped_pairs("Men work. Nothing here! Women and men rest", following) == [
        (["men"], ["women"]), (["men"], []), (["women"], [])]


def test_odd_rows(spark):
    rows = [(k, "a vileword here" if k % 2 else f"a plain text {k}") for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, "vileword"), (100, None), (101, ""), (102, "plain " * 90_000), (1, "vilewords again")],
                                 "doc_id long, text string").selectExpr("*", "'x' as score", "1 as target", "2 as toxic")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(None, 1, 1), (5, None, None), (7, 0, 0), (99, 1, 0)], LABELS)
    # Copies count once when learning, so the texts differ here.
    model = toxicity.fit(docs.selectExpr("doc_id", "concat(text, ' t', char(97 + doc_id % 26)) as text"), labels)
    got = toxicity.judged(docs, model).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] > 0.5) == ("vileword" in r["text"]) for r in got if r["text"])
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101)}) == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 0, 1)], 1.0), ([(1, 0, 0)], 0.0), ([(1, 0, 0), (1, 0, 1)], 0.0)])
def test_nothing_to_learn(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert [r["score"] for r in toxicity.judged(docs, model).collect()] == [score] * 2
    assert toxicity.judged(docs.where("false"), model).count() == 0


def test_the_penalty_is_at_work_where_no_text_names_a_group(spark):
    """On the given documents, none of which holds an identity term."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model["pairs"] >= 100
    weights = model["weights"]
    terms = {w for kind in toxicity.IDENTITY_TERMS for w in kind}
    assert max(weights[f] for f in terms) < 0.05
    scorer = toxicity.Scorer(model)
    plain = docs.select("text").limit(50).collect()
    assert all(abs(scorer(f"{a} {r['text']}") - scorer(f"{b} {r['text']}")) < 0.02 for r in plain for a, b in (("women", "men"), ("juden", "christen"), ("femmes", "hommes")))


def test_scores_are_sums_of_the_weights_of_words_and_beginnings(spark):
    model = {"weights": {"abcdefg": 1.0, "abcd-": 0.5, "abcde-": 0.25, "xyz": 2.0}, "intercept": -1.0, "whole": frozenset(["abcdwhole"])}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["abcdefg", "Abcdefgh", "abcd", "abc", "xyz", "wxyz", "abcdwhole", "é1"]) for _ in range(rng.randrange(6)))) for k in range(60)] + [(99, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.judged(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        words = {w.lower() for w in (t or "").split()}
        z = -1.0 + ("abcdefg" in words) + 0.5 * any(w.startswith("abcd") for w in words - {"abcdwhole"}) + 0.25 * any(w.startswith("abcde") for w in words) + 2.0 * ("xyz" in words)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)))


def test_texts_scored_together_score_as_each_alone():
    """By definition: a text's features, in the order of their names, summed."""
    rng = random.Random(5)
    model = {"weights": {f: rng.random() for f in ["abcdefg", "abcd-", "abcde-", "abcdefg-", "straß-", "straße", "xyz", "½", "σας", "abcdwhole"]}, "intercept": -1.0, "whole": frozenset(["abcdwhole", "abcdegone"])}
    words = ["abcdefg", "Abcdefgh", "abcd", "abc", "XYZ", "abcdwhole", "abcdegone", "Straßen", "straße", "½", "ΣΑΣ", "a1abcde", "_xyz_", "\u2028", "0", "--"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(300)] + ["", None, "xyz", " xyz "]
    scorer = toxicity.Scorer(model)
    want = []
    for t in texts:
        found = toxicity.features(toxicity.WORD.findall((t or "").lower()), model["whole"]) & model["weights"].keys()
        z = model["intercept"] + sum(model["weights"][f] for f in sorted(found))
        want.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
    assert scorer.scores(texts) == want == [scorer(t) for t in texts] and scorer.scores([]) == []


def test_any_character_parts_words_alike():
    """Texts are split by Arrow when scored, and by Python when learned from."""
    held = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    parts = toxicity.pc.match_substring_regex(toxicity.pa.array(held), toxicity.NO_WORD).to_pylist()
    assert [c for c, x in zip(held, parts, strict=True) if x == bool(toxicity.WORD.match(c))] == []


def test_the_sample_is_encoded_once(spark, monkeypatch):
    written, write = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: written.append(write(df, label)) or written[-1])
    docs = spark.createDataFrame([(k, f"a vileword {k}" if k % 2 else f"a plain text {k}") for k in range(40)], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(40)], LABELS))["pairs"] == 40
    assert len(written) == 1 and {"found", "lost", "gained"} <= set(written[0].columns)
