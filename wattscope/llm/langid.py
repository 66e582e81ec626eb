"""Language identification with language-bitmask n-gram filters.

Learning: character n-grams (2 to 4 letters, over word ends) that occur in enough documents of a language
go into that language's Bloom filter. All filters share their hash functions, so they are kept bit-sliced:
row h of the table is a mask with one bit for each language, and the AND of an n-gram's rows is the mask of
all languages that contain it. A mask has a number for each 62 languages, so no language is left out.

Prediction: the popcount of each language's bit over a text's n-grams, corrected for false positives. With
false positive rate f (fill of the language's slice to the power of the hash functions), a share s of hits
stands for (s - f) / (1 - f) n-grams contained. The language with the largest corrected share wins; ties go
to the language with more training documents, then to the smaller name.

The table has a fixed number of rows whatever the corpus holds (16 MB for each 62 languages), and is fitted on a sample of at most about
``fit_rows`` documents of each language; every n-gram of every text is looked up.

Defined cases: a text that is null or without a letter, or any text where nothing could be learned, is
``und`` with score 0; a null doc_id or lang is scored like any other row; repeated rows are each scored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import bounded_sample

ORDERS = (2, 3, 4)
ROWS = 1 << 21
HASHES = 3
MASK_BITS = 62
UNKNOWN = "und"


@cache
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text's words, each word between blanks; empty if it has no letter."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letter = c != 32
    if not letter.any():
        return np.empty(0, np.uint64)
    c = np.concatenate([[32], c[letter | np.r_[True, letter[:-1]]], [32]]).astype(np.uint64)
    blank = c == 32
    # At the ends a blank may have been there already: one is enough.
    c = c[1 if blank[1] else 0:len(c) - 1 if blank[-2] else len(c)]
    blank = c == 32
    out, h = [], c
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1:]
        if n in ORDERS:
            # Not across a word's end: a blank stands first or last only.
            inner = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inner |= blank[k:k + len(h)]
            out.append(_mix(h[~inner] + np.uint64(n << 56)))
    return np.concatenate(out)


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The rows of the table in which n-grams are looked up."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(ROWS - 1)).astype(np.int64) for i in range(HASHES)]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, documents), summed up before it leaves the task."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(grams), 100_000):
                g, c = grams[at:at + 100_000], n[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            got = np.unique(ngrams(text))
            held.setdefault(lang, []).append(got)
            size += len(got)
        if size > 8_000_000:
            yield from out()
            size = 0
    yield from out()


def fit(docs: DataFrame, train: Column, fit_rows: int = 8000, least_share: float = 0.002, least_docs: int = 2) -> dict:
    """The table and what is known of each language, learned from ``text, lang`` of rows where ``train``.

    An n-gram is in a language's filter if at least ``least_docs`` documents and a ``least_share`` of its
    sampled documents have it.
    """
    known = docs.select("doc_id", "text", "lang").where(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = bounded_sample(known, "lang", fit_rows)
    n_docs = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(n_docs, key=lambda x: (-n_docs[x], x))
    table = np.zeros((ROWS, max(1, -(-len(langs) // MASK_BITS))), np.int64)
    if langs:
        bit = part = least = F
        for i, x in enumerate(langs):
            same = F.col("lang") == F.lit(x)
            bit, part = bit.when(same, F.lit(1 << i % MASK_BITS).cast("long")), part.when(same, F.lit(i // MASK_BITS))
            least = least.when(same, F.lit(float(max(least_docs if n_docs[x] >= 50 else 1, least_share * n_docs[x]))))

        def rows_of(batches):
            for batch in batches:
                at = _places(batch.column("gram").to_numpy().view(np.uint64))
                part, bit = (np.tile(batch.column(c).to_numpy(), HASHES) for c in ("part", "bit"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(part), pa.array(bit)], ["at", "part", "mask"])

        counts = (sample.select("lang", "text").mapInArrow(_document_counts, "lang string, gram long, n long")
                  .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        slices = (counts.groupBy("gram", part.alias("part")).agg(F.bit_or(bit).alias("bit")).mapInArrow(rows_of, "at long, part int, mask long")
                  .groupBy("at", "part").agg(F.bit_or("mask").alias("mask")))
        got = slices.toArrow()  # at most one row for each number of the table
        table[got.column("at").to_numpy(), got.column("part").to_numpy()] = got.column("mask").to_numpy()
    fill = [float(_has(table, i).mean()) for i in range(len(langs))]
    small = table[:, 0].astype(np.uint8) if len(langs) <= 8 else table
    return {"langs": langs, "false_positive": [x ** HASHES for x in fill], "table": small}


def _has(masks: np.ndarray, i: int) -> np.ndarray:
    """The bit of language ``i`` in each mask."""
    return masks[:, i // MASK_BITS] >> i % MASK_BITS & 1


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's corrected share)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 16 MB for each 62 languages: the table has a fixed number of rows

    def decide(batches):
        langs, table = sent.value["langs"], sent.value["table"]
        wrong = np.array(sent.value["false_positive"])
        for batch in batches:
            names, scores = [], []
            for text in batch.column("_text").to_pylist():
                grams = ngrams(text) if text and langs else ()
                if not len(grams):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                first, *rest = _places(grams)
                mask = table[first]
                for at in rest:
                    mask = mask & table[at]
                hits = (np.bincount(mask, minlength=1 << len(langs)) @ _bits(len(langs)) if len(langs) <= 8
                        else np.array([np.count_nonzero(_has(mask, i)) for i in range(len(langs))]))
                share = np.clip((hits / len(grams) - wrong) / (1 - wrong), 0, 1)
                best = int(np.argmax(share))
                names.append(langs[best])
                scores.append(float(share[best]))
            kept = [batch.column(c) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores, pa.float64())], [*[c for c in batch.schema.names if c != "_text"], "lang_pred", "score"])

    kept = [f for f in docs.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    return docs.mapInArrow(decide, schema)


@cache
def _bits(n: int) -> np.ndarray:
    return np.array([[m >> i & 1 for i in range(n)] for m in range(1 << n)])
