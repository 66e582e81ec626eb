"""Packing: every id in exactly one piece, limits kept, no padding, ids as the tokenizer gives them."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattscope.llm.packing import Limits, Packer, WordCache, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def power_of_two(n):
    return n & (n - 1) == 0


def check(pieces, ids_of, limits):
    """``pieces``: rows as dictionaries; ``ids_of``: the ids of each key."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == {k for k, ids in ids_of.items() if len(ids)}
    for key, own in by_doc.items():
        ids, at = ids_of[key], 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_seq.values():
        total = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == total
            total += p["length"]
        assert total == limits.tokens or total < limits.tokens and power_of_two(total)
        assert len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40), st.integers(1, 4), st.integers(1, 6), st.booleans(), st.integers(0, 99))
def test_packer_keeps_limits(sizes, segments, pool, masked, seed):
    rng = np.random.default_rng(seed)
    limits = Limits(tokens=32, segments=segments, loss_tokens=9 if masked else 32, pool_items=pool)
    packer, out, ids_of = Packer(limits, 0), [], {}
    for k, n in enumerate(sizes):
        ids_of[k] = rng.integers(0, 999, n).astype("<u4")
        out += [x for s in packer.add(k, ids_of[k], rng.integers(0, 2, n) if masked else None) for x in s]
    out += [x for s in packer.finish() for x in s]
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    check([dict(zip(names, p, strict=True)) for p in out], ids_of, limits)


TEXTS = ["Hello, world. It's THE end...", "", "a.b,c d. e, f", "Σίσυφος ΟΔΟΣ. x", "été É. ñandú, ß", "x<|endoftext|>y z",
         "tab\tand nbsp line\r\n\x1cok", "don't they'll we've 'S, a'S. b", "١٢٣ ² ½. 4,5 6. 7", "🙂🙂. 中文，字。", "é. ́x, İstanbul."]


def test_words_give_the_tokenizers_ids():
    with open(PATH, encoding="utf-8") as f:
        cache = WordCache(f.read(), most_words=20)
    for _ in range(2):
        for text, ids in zip(TEXTS, cache.encode(TEXTS, 2), strict=True):
            assert ids.tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2], text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,'sStT\nΣéÉ")), max_size=40))
def test_any_text_gives_the_tokenizers_ids(text):
    global CACHE
    if "CACHE" not in globals():
        with open(PATH, encoding="utf-8") as f:
            CACHE = WordCache(f.read())
    assert CACHE.encode([text], 2)[0].tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]


def test_documents(spark):
    rows = [(1, "one two three", "en", 7), (2, None, None, 7), (3, "", "en", 7), (None, "no id", "en", 7), (5, "word " * 9000, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, ids int").coalesce(1)
    got = [r.asDict() for r in pack_documents(docs, PATH).collect()]
    ids_of = {r[0]: [*TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    check(got, ids_of, Limits())
    assert pack_documents(docs.where("doc_id > 9"), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 5, "doc_id long, text string").coalesce(1)
    got = pack_documents(docs, PATH).collect()
    assert sum(r["length"] for r in got) == 5 * got[0]["doc_tokens"]


def test_instruction_items(spark):
    rows = [(k, list(range(n)), [int(j * 2 >= n) for j in range(n)]) for k, n in enumerate((900, 50, 3000, 1, 0, 700))]
    items = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<int>").coalesce(1)
    limits = Limits(tokens=1024, segments=3, loss_tokens=400)
    got = [r.asDict() for r in pack(items, limits).collect()]
    check(got, {k: ids for k, ids, _ in rows}, limits)
    assert pack(items.selectExpr("doc_id", "cast(null as array<int>) ids"), limits).count() == 0


def test_limit_that_lets_nothing_in():
    with pytest.raises(ValueError):
        packer = Packer(Limits(loss_tokens=0), 0)
        list(packer.add(1, np.ones(4, "<u4")))
        list(packer.finish())
