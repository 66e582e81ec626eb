"""Ranked lexical search: the best documents of each item, by MaxScore with bounds for pairs of terms.

Documents are read once into a written table of the numbers and counts of the items' terms, a row for each document.
Items are then taken in blocks of bounded size. For a block, postings with their impacts are dealt over shards by
document; every shard builds the lists of its terms and, for the pairs of terms that items look up together, intersection lists with the largest
joint impact. A list also names its best joint impacts: over all shards they give each item a score that 20
documents reach for sure, the first threshold.

A shard then answers all items of the block. What a pair of terms can add to a document is at most its bound:
the joint maximum where both occur, the single maximum where one does. That is below the sum of both maxima,
since documents rarely hold the largest impact of two terms at once. Pairs are ordered by bound; as many of the
weakest as stay below the threshold together can make no document a result by themselves, so only documents of
the other pairs are scored, and these are dropped as soon as the bounds of what is left can't lift them to the
threshold, which rises with the scores found. Bounds are never below a score, so nothing is lost.

Arithmetic is exact in 64-bit integers apart from the weight's logarithm.

Defined cases: null texts have no terms; rows without doc_id take no part at all; every other row is a document
of its own, repeated ones too; items without id or without terms have no rows; of several rows of an item the
smallest text counts; equal scores go by ascending doc_id. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscope.llm.common import materialize, new_folder

#: Fixed: what a term is, and the constants of a score.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: What is between terms. Documents are split in the tasks that count: Spark's regexp_extract_all took seven times as long.
GAP = TERM.replace("^", "")
UNIT, SATURATION, LENGTH_SHARE = 1000, 12, 25
#: Items of a block; their terms are sent to every task.
BLOCK = 512
#: Postings of a shard, about.
SHARD = 400_000
#: Terms of all items that are sent to every task; more of them meet the documents' terms in a join.
MOST_SENT = 200_000
LISTS = "shard int, a int, b int, ids array<long>, docs array<long>, s array<long>, top long, best array<long>"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


def _counted(batches: Iterator[pa.RecordBatch], terms: pa.Array | None = None, numbers: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Each document with a term: its length, and the numbers of its terms that are in ``terms`` with their counts; without ``terms`` all of them, as text."""
    for b in batches:
        words = pc.split_pattern_regex(pc.ascii_lower(b.column("text")), pattern=GAP)
        row, word = pc.list_parent_indices(words).to_numpy(), words.flatten()
        # A gap at either end of a text leaves an empty word.
        lengths = np.bincount(row[pc.not_equal(word, "").to_numpy(zero_copy_only=False)], minlength=len(b))
        known = pc.unique(word.filter(pc.not_equal(word, ""))) if terms is None else terms
        place = pc.index_in(word, value_set=known)
        met = place.is_valid().to_numpy(zero_copy_only=False)
        size = max(len(known), 1)
        key, tf = np.unique(row[met] * size + place.drop_null().to_numpy(), return_counts=True)
        cuts = pa.array(np.searchsorted(key, np.arange(len(b) + 1) * size), pa.int32())
        found = (known if terms is None else numbers).take(pa.array(key % size))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), pa.array(lengths), pa.ListArray.from_arrays(cuts, found),
             pa.ListArray.from_arrays(cuts, pa.array(tf))], ["row", "doc_id", "n", "t", "tf"]).filter(pa.array(lengths > 0))


def postings(docs: DataFrame, wanted: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``row, doc_id, n, t, tf``, written: a row for each document with a term, its length, and the numbers and counts of its terms in ``wanted`` (term, t).

    Most terms of a document are in no item, so they are dropped where they are counted, while the wanted ones are few enough to be sent to every task.
    """
    texts = docs.where("doc_id is not null and text is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    if wanted.count() <= most_sent:
        rows = wanted.collect()
        terms, numbers = pa.array([r["term"] for r in rows], pa.string()), pa.array([r["t"] for r in rows], pa.int64())
        return materialize(texts.mapInArrow(lambda x: _counted(x, terms, numbers), "row long, doc_id long, n long, t array<long>, tf array<long>"), "postings")
    every = materialize(texts.mapInArrow(_counted, "row long, doc_id long, n long, t array<string>, tf array<long>"), "every-term")
    met = (every.select("row", F.inline(F.arrays_zip(F.col("t").alias("term"), F.col("tf").alias("tf")))).join(wanted, "term")
           .groupBy("row").agg(F.collect_list(F.struct("t", "tf")).alias("met")))
    none = F.array().cast("array<long>")
    return materialize(every.select("row", "doc_id", "n").join(met, "row", "left")
                       .select("row", "doc_id", "n", F.coalesce("met.t", none).alias("t"), F.coalesce("met.tf", none).alias("tf")), "postings")


class _Items:
    """The items of a block: their terms by number, weights, and the pairs of terms that are looked up together.

    Pairs are neighbours by weight, so frequent terms meet each other and the rare ones each other.
    """

    def __init__(self, rows: list, weights: dict[str, int], numbers: dict[str, int]):
        self.number = {t: i for i, t in enumerate(sorted(weights))}
        self.weight = np.array([weights[t] for t in sorted(weights)], np.int64)
        self.t = np.array([numbers[t] for t in sorted(weights)], np.int64)
        self.ids, self.units = [], []
        for r in rows:
            counts = Counter(t for t in r["words"] if t in self.number)
            known = sorted(counts, key=lambda t: (weights[t], t))
            self.ids.append(r["item_id"])
            self.units.append([tuple((self.number[t], counts[t]) for t in known[i:i + 2]) for i in range(0, len(known), 2)])
        self.pairs = sorted({(u[0][0], u[1][0]) for units in self.units for u in units if len(u) == 2})
        self.least: list[int] = [0] * len(rows)

    def sure(self, best: dict[tuple[int, int], list[int]], k: int) -> None:
        """First thresholds: the k-th best joint impact of one of an item's lists is reached by k documents."""
        for i, units in enumerate(self.units):
            for unit in units:
                lists = [((t, -1), c) for t, c in unit] + ([((unit[0][0], unit[1][0]), min(c for _, c in unit))] if len(unit) == 2 else [])
                for key, c in lists:
                    if len(reached := best.get(key, ())) >= k:
                        self.least[i] = max(self.least[i], reached[k - 1] * c)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shards = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column("shard")[0].as_py() != shards[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _impacts(batches: Iterator[pa.RecordBatch], items: _Items, n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Each document's terms of the block by number, with their impacts."""
    known = pa.array(items.t, pa.int64())
    for b in batches:
        parent, tf = pc.list_parent_indices(b.column("t")).to_numpy(), b.column("tf").flatten().to_numpy()
        place = pc.index_in(b.column("t").flatten(), value_set=known)
        met = place.is_valid().to_numpy(zero_copy_only=False)
        term, parent, tf = place.drop_null().to_numpy(), parent[met], tf[met]
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * b.column("n").to_numpy() * n_docs // total
        s = items.weight[term] * (1_000_000_000 * tf // (UNIT * tf + SATURATION * m[parent]))
        cuts = pa.array(np.searchsorted(parent, np.arange(len(b) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.ListArray.from_arrays(cuts, pa.array(term)), pa.ListArray.from_arrays(cuts, pa.array(s))],
                                         ["row", "doc_id", "t", "s"]).filter(pa.array(np.diff(cuts) > 0))


def _lists(batches: Iterator[pa.RecordBatch], items: _Items, k: int) -> Iterator[pa.RecordBatch]:
    """The lists of terms and of pairs of each shard; ``b`` is -1 for a single term. Pair lists keep their figures, not their members."""
    for t in _groups(batches):
        shard, terms = t.column("shard")[0].as_py(), t.column("t").combine_chunks()
        at = pc.list_parent_indices(terms).to_numpy()
        row, doc = t.column("row").to_numpy()[at], t.column("doc_id").to_numpy()[at]
        term, s = terms.flatten().to_numpy(), t.column("s").combine_chunks().flatten().to_numpy()
        order = np.lexsort((row, term))
        term, row, doc, s = term[order], row[order], doc[order], s[order]
        lo, hi = np.searchsorted(term, np.arange(len(items.weight))), np.searchsorted(term, np.arange(len(items.weight)), side="right")
        out: list[tuple] = []
        for a in np.flatnonzero(hi > lo).tolist():
            at = slice(lo[a], hi[a])
            out.append((shard, a, -1, row[at], doc[at], s[at], int(s[at].max()), np.sort(s[at])[::-1][:k]))
        for a, b in items.pairs:
            x, y = row[lo[a]:hi[a]], row[lo[b]:hi[b]]
            if len(x) and len(y):
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                if len(i):
                    joint = s[lo[a]:hi[a]][i] + s[lo[b]:hi[b]][j]
                    out.append((shard, a, b, [], [], [], int(joint.max()), np.sort(joint)[::-1][:k]))
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[at:at + 64], strict=True), (
                pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.list_(pa.int64())), strict=True)],
                ["shard", "a", "b", "ids", "docs", "s", "top", "best"])


def _bound(unit: tuple, single: dict[int, int], joint: dict[tuple[int, int], int]) -> int:
    """The most that the terms of a unit add to a document."""
    alone = [single.get(t, 0) * c for t, c in unit]
    if len(unit) == 1 or not all(alone):
        return sum(alone)
    (a, x), (b, y) = unit
    both = joint.get((a, b))
    if both is None:
        return max(alone)
    c = min(x, y)
    # Repeats in the item beyond those both terms have are bounded one by one.
    return max(*alone, c * both + (x - c) * single[a] + (y - c) * single[b])


def _answers(batches: Iterator[pa.RecordBatch], items: _Items, k: int) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        a, b, top = (t.column(c).to_numpy() for c in ("a", "b", "top"))
        single = {int(x): int(m) for x, y, m in zip(a, b, top, strict=True) if y < 0}
        joint = {(int(x), int(y)): int(m) for x, y, m in zip(a, b, top, strict=True) if y >= 0}
        members, starts = t.column("ids").combine_chunks(), t.column("ids").combine_chunks().offsets.to_numpy()
        flat = [t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "docs", "s")]
        starts = starts - starts[0]
        rows, first, local = np.unique(flat[0], return_index=True, return_inverse=True)
        doc = flat[1][first]
        place = {int(x): (starts[i], starts[i + 1]) for i, (x, y) in enumerate(zip(a, b, strict=True)) if y < 0}
        assert len(members) == len(a)
        total = np.zeros(len(rows), np.int64)
        out = []
        for item, units, least in zip(items.ids, items.units, items.least, strict=True):
            ranked = sorted(((_bound(u, single, joint), u) for u in units if any(x in single for x, _ in u)), key=lambda x: x[0])
            bounds = np.cumsum([x for x, _ in ranked]) if ranked else np.zeros(0, np.int64)
            weak = int(np.searchsorted(bounds, least))  # units 0..weak-1 stay below the threshold together
            touched = []
            for _, unit in ranked[weak:]:
                for x, c in unit:
                    if x in place:
                        lo, hi = place[x]
                        np.add.at(total, local[lo:hi], flat[2][lo:hi] * c)
                        touched.append(local[lo:hi])
            if not touched:
                continue
            left = np.unique(np.concatenate(touched))
            for i in range(weak - 1, -1, -1):
                if len(left) > k:
                    least = max(least, int(np.partition(total[left], -k)[-k]))
                left_over = left[total[left] + bounds[i] >= least]
                total[np.setdiff1d(left, left_over, assume_unique=True)] = 0
                left = left_over
                for x, c in ranked[i][1]:
                    if x in place:
                        lo, hi = place[x]
                        own = local[lo:hi]
                        # Both are sorted by row.
                        at = np.minimum(np.searchsorted(own, left), len(own) - 1)
                        met = own[at] == left
                        total[left[met]] += flat[2][lo:hi][at[met]] * c
            best = left[np.lexsort((rows[left], doc[left], -total[left]))][:k]
            out.append((np.full(len(best), item, np.int64), rows[best], doc[best], total[best].copy()))
            total[left] = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["item_id", "row", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, shard: int = SHARD, most_sent: int = MOST_SENT) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = materialize(items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
                        .select("item_id", _terms(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    n_items = asked.count()
    if not n_items:
        return spark.createDataFrame([], schema)
    # Written, so that a term keeps its number.
    wanted = materialize(asked.select(F.explode("words").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "wanted")
    held = postings(docs, wanted, most_sent)
    n_docs, total, n_rows = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    weights = materialize(held.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
                          .select("t", F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")), "weights")
    path, blocks, shards = new_folder(spark, "ranked"), -(-n_items // block), max(1, -(-n_rows // shard))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        mine = part.select(F.explode("words").alias("term")).distinct().join(wanted, "term").join(weights, "t").collect()
        of = _Items(part.collect(), {r["term"]: r["w"] for r in mine}, {r["term"]: r["t"] for r in mine})
        dealt = (held.mapInArrow(lambda x, of=of: _impacts(x, of, n_docs, total), "row long, doc_id long, t array<int>, s array<long>")
                 .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard"))
        lists = materialize(dealt.mapInArrow(lambda x, of=of: _lists(x, of, k), LISTS), "lists")
        # Of each list and shard the best k; a window keeps k of them in every task.
        top = Window.partitionBy("a", "b").orderBy(F.desc("x"))
        reached = (lists.select("a", "b", F.explode("best").alias("x")).withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
                   .where(F.col("place") == k).select("a", "b", "x").collect())
        of.sure({(r["a"], r["b"]): [r["x"]] * k for r in reached}, k)
        found = lists.drop("best").repartition("shard").sortWithinPartitions("shard").mapInArrow(
            lambda x, of=of: _answers(x, of, k), "item_id long, row long, doc_id long, score long")
        (found.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
         .select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)
