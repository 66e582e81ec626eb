"""The pipeline, stage by stage, against brute force on the smallest table and on planted rows."""

import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import test_decontam, test_jaccard, test_packing, test_pii
from wattscope.llm.common import new_folder
from wattscope.llm.packing import Limits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = rows_of(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "personal_data", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_folder(spark, "stage-test")
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == COLUMNS, name
        kept.append(rows_of(docs))
    good, single, clean, private = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    right = [(k in good) == (labels[k] == 1) for k in before if k in labels]
    assert sum(right) / len(right) > 0.95

    classes = {k: c for k, c, _ in test_jaccard.brute(list(good.items()))}
    assert set(single) == set(classes.values())
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean) == {r[0] for r in test_decontam.brute(list(single.items()), items) if not r[4]}

    terms = test_pii.risky_terms(clean.values())
    for k, text in private.items():
        spans = test_pii.spans(clean[k], terms)
        assert (text == clean[k]) == (not spans)
        assert not any(kind == "email" for kind, _, _ in test_pii.base(text))
    assert {r["doc_id"]: r["n_chars"] for r in docs.collect()} == {k: len(t) for k, t in private.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = [r.asDict() for r in corpus_pipeline.packing_stage(spark, docs, d).collect()]
    test_packing.check(packed, {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in private.items()}, Limits())
    assert sum(r["length"] for r in corpus_pipeline.run(spark, d).collect()) == sum(r["length"] for r in packed)


def test_planted_rows_and_odd_rows(spark, tmp_path):
    d, plain = str(tmp_path), "Some {} words {} make one {} plain sentence {} about {} nothing."
    text = lambda k: " ".join(plain.format(*(f"{w}{k}x" for w in "abcde")).replace("Some", f"Some{j}") for j in range(4))
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(k, text(k)) for k in range(40)]
    rows += [(100, text(1)), (101, text(1) + " end"), (102, item), (103, text(50) + " jo@mail.example.org"), (104, None), (105, ""), (None, text(60)),
             (2, text(2)), (106, "long " * 30_000)]
    # Other columns that have the names the stages use inside, or those of what they add.
    others = ["_score", "score", "predicted", "contamination", "_hits", "_k1", "_k2", "_key", "_terms", "pii", "_clean", "clean", "_hash", "_own", "doc", "_id", "_gone",
              "term", "words", "node", "band", "component", "text_hash", "target", "h", "item_id", "Contamination_", "start", "row"]
    spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in others)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = new_folder(spark, "stage-test")
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [*COLUMNS, *others]
    left = docs.collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in left for c in others)
    assert sorted((r["doc_id"] for r in left), key=str) == sorted([*range(40), 103, 104, 105, None, 106], key=str)
    private = next(r for r in left if r["doc_id"] == 103)
    assert private["text"].endswith(" [EMAIL]") and private["n_chars"] == len(private["text"])
    assert not re.search("@", private["text"])
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_a_name_beside_one_mention_goes(spark):
    filler = [(k, " ".join(f"{a}{b}{c}" for a in ("bantaro", "corlin", "delmir") for b in "aeiou" for c in "aeiou") + " ") for k in range(100)]
    rows = [(k, t * 20) for k, t in filler] + [(100, "bantaroaa corlinue zephyrine jo@mail.example.org delmiroo bantaroea")]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.personal_data_stage(spark, docs, "").collect()}
    assert got[100]["text"] == "bantaroaa corlinue [TERM] [EMAIL] delmiroo bantaroea" and got[100]["n_chars"] == len(got[100]["text"])
    assert all(got[k]["text"] == t for k, t in rows[:100])
