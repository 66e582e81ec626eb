"""Benchmark decontamination by winnowing, in Spark functions only.

A word of a document is hit if it lies inside any occurrence of a window of an item: ``window`` consecutive
words, or the whole item where it has fewer.

Fingerprints: of each run of ``window - gram + 1`` k-grams (``gram`` words, hashed) the smallest hash is
kept. A shared span of ``window`` words is such a run on both sides, so both keep the same k-gram of it, at
the same place: every shared span of that length is found. Fingerprints of documents and items are joined by
hash; the join is a lookup in the task where the items' table is small, else a shuffle of a fifth of the
words. Each hit gives a diagonal (document position minus item position), along which the item's words are
compared with the document's, and windows that match in full count. So hits are verified on the words, and
a hash that two k-grams share costs a comparison only. Items shorter than a window are looked up whole, by
a k-gram of their own length at every position.

Defined cases: a null text, of document or item, has no words; an item without words or without item_id takes
no part; repeated documents are each judged and share their hits; a null doc_id is judged; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import materialize
from wattscope.llm.native import indices, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is a long: hash above, position below.
POSITION_BITS, HASH_BITS = 30, 33
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Words with A-Z in lower case; other letters stay as they are."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def _grams(hashes: Column, n: int) -> Column:
    """Hash and position of each n-gram."""
    def one(i: Column) -> Column:
        h = F.xxhash64(F.lit(n), *(F.get(hashes, i + k) for k in range(n)))
        return F.shiftleft(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), POSITION_BITS).bitwiseOR(i.cast("long"))

    return F.transform(indices(0, F.size(hashes) - n), one)


def fingerprints(text_words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Winnowed fingerprints, and all n-grams of the lengths in ``short``."""
    run = window - gram + 1

    def winnow(grams: Column) -> Column:
        return F.array_distinct(F.transform(indices(1, F.size(grams) - (run - 1)), lambda i: F.array_min(F.slice(grams, i, run))))

    def both(h: Column) -> Column:
        return F.concat(let(_grams(h, gram), winnow), *(_grams(h, n) for n in short))

    return let(F.transform(text_words, lambda w: F.xxhash64(w)), both)


def _hash_and_place(fingerprint: Column) -> list[Column]:
    return [F.shiftright(fingerprint, POSITION_BITS).alias("h"), fingerprint.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("at")]


def _occurrences(doc_words: Column, hit: Column, window: int) -> Column:
    """First positions in the document of the item's windows that match along the hit's diagonal."""
    item, shift = hit["words"], hit["shift"]
    n = F.least(F.lit(window), F.size(item))

    def starts(equal: Column) -> Column:
        return F.filter(indices(0, F.size(item) - n), lambda s: F.forall(F.slice(equal, s + 1, n), lambda x: x))

    equal = F.transform(indices(0, F.size(item) - 1), lambda j: F.coalesce(F.get(doc_words, shift + j) == F.get(item, j), F.lit(False)))
    return F.transform(let(equal, starts), lambda s: s + shift)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, name: str = "contamination") -> DataFrame:
    """``docs`` with a column ``name`` behind all others (one of that name gives way): ``n_words``, ``positions`` of the words hit (from 0, in no
    order) and ``items``, the item_ids with occurring windows as sorted strings."""
    items = materialize(benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words"))
                        .where(F.size("words") > 0), "items")
    # At most window - 1 values, whatever the benchmark's size.
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())
    own = F.when(F.size("words") >= window, fingerprints(F.col("words"), window, gram, []))
    for n in short:
        own = own.when(F.size("words") == n, _grams_of_words(F.col("words"), n))
    keys = materialize(items.select("item_id", F.explode(own).alias("f")).select("item_id", *_hash_and_place(F.col("f"))), "item-keys")

    # By the text too, or all rows without doc_id would be one group.
    keys_of = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k1"), F.xxhash64("text").alias("_k2")]
    of_docs = docs.select(*keys_of, F.explode(fingerprints(words(F.col("text")), window, gram, short)).alias("f"))
    met = (of_docs.select("_k1", "_k2", *_hash_and_place(F.col("f")))
           .join(keys.select("item_id", "h", F.col("at").alias("from")), "h")
           .select("_k1", "_k2", "item_id", (F.col("at") - F.col("from")).alias("shift")).distinct())
    hits = met.join(items, "item_id").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("_hits"))

    def judge(w: Column) -> Column:
        n = lambda hit: F.least(F.lit(window), F.size(hit["words"]))
        found = F.filter(F.transform(F.coalesce("_hits", F.array()), lambda hit: F.struct(
            hit["item_id"].cast("string").alias("item"), n(hit).alias("n"), _occurrences(w, hit, window).alias("starts"))),
            lambda x: F.size(x["starts"]) > 0)
        return let(found, lambda f: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.array_distinct(F.flatten(F.transform(f, lambda x: F.flatten(F.transform(
                x["starts"], lambda s: F.sequence(s, s + x["n"] - 1)))))).alias("positions"),
            F.array_sort(F.array_distinct(F.transform(f, lambda x: x["item"]))).alias("items")))

    # As one column, so that no name of a document's column meets one of these.
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns if c.lower() != name.lower())).alias("doc"), *keys_of)
    # The result joins the others there: beside "doc.*" a name could be taken for one of the document's.
    return (whole.join(hits, ["_k1", "_k2"], "left").select(F.col("doc").withField(name, let(words(F.col("doc.text")), judge)).alias("doc"))
            .select("doc.*"))


def _grams_of_words(text_words: Column, n: int) -> Column:
    return let(F.transform(text_words, lambda w: F.xxhash64(w)), lambda h: _grams(h, n))


def is_contaminated(percent: int = 5, name: str = "contamination") -> Column:
    """Whether hit words make up ``percent`` of a marked document's words at least."""
    hit, n = F.size(F.col(name)["positions"]), F.col(name)["n_words"]
    return (hit > 0) & (100 * hit >= percent * n)
