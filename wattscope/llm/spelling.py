"""Spelling variants: words one insertion, deletion or replacement apart, and the form each word stands for.

Words are matched by a bit-sliced position index: for every position and letter a bitset over the words of a
page tells which of them have that letter there. A word is followed letter by letter through these bitsets, all
words of the page at once, with two kinds of sets: the words without an error so far, and those with one. The
latter come twice, by replacement (same position) and by an inserted letter (the words' positions shifted by
one); a deleted letter is an inserted one seen from the other word.

Pages are cut so that no pair is lost. Of two words with one error, the shorter of length L, either the first or
the last L // 2 letters are free of it. So a word goes to blocks named by its first and its last half, once as
the shorter (L is its length) and once as the longer (L is one less), and pairs are formed inside blocks only. A
block of more than ``part`` words is dealt into parts by hash, and every two parts meet in a task of their own.
Small blocks share a page. Memory in a task is that of a page: about ``page`` words or two parts. A pair counts
in one block (that of the first halves if they agree) and one pair of parts, so none is found twice.

Defined cases: null texts have no words; a null doc_id counts as an empty text before the colon of the hashed
name; repeated rows count as often as they occur; very long words are words like others, their bitsets are made
for one position after the other; ties of n go to the smaller word in code-point order; an empty table has no
words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import materialize

#: Fixed: what a run of letters is.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Fixed: a run loses a letter where this divides its checksum.
DIVISOR = 199
SMALLEST = 6
PAGE, PART = 2048, 4096
PAIRS = "word string, near string, near_n long"


def vocabulary(docs: DataFrame, least: int = 5) -> DataFrame:
    """``word, n`` of the words of ``docs`` (doc_id, text) that occur ``least`` times.

    Runs too short for a word are gone before they become rows, and counts are taken in the task first.
    """
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.filter(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0)), lambda r: F.char_length(r) >= SMALLEST)
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DIVISOR == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (docs.select("doc_id", F.explode(runs).alias("run")).withColumn("h", h).select(word.alias("word"))
            .where(F.char_length("word") >= SMALLEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


def _blocks(words: DataFrame, part: int) -> DataFrame:
    """Each word once for every task it takes part in: ``tile, size, back, block, i, j, own, word, n``."""
    length = F.char_length("word")
    half = F.expr("size div 2")
    named = (words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
             .select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
             .withColumn("block", F.xxhash64("size", "back", F.when(F.col("back"), F.expr("right(word, size div 2)")).otherwise(F.substring("word", F.lit(1), half)))))
    # Written, so that its size is known before the join is planned: most often it is empty.
    large = materialize(named.groupBy(F.col("block").alias("of")).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > part)
             .select("of", F.ceil(F.col("held") / part).cast("int").alias("parts")), "large")
    dealt = (named.join(large, named["block"] == large["of"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("word", F.lit("part")), "parts").cast("int")))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return met.select("size", "back", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


class _Page:
    """Words of some tiles, and the pairs of them that are one error apart."""

    def __init__(self, words: list[str], n: np.ndarray, group: np.ndarray, back: np.ndarray, own: np.ndarray, apart: np.ndarray, size: np.ndarray):
        self.words, self.n, self.group, self.back, self.own, self.apart, self.size = words, n, group, back, own, apart, size
        self.width = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(self.width, kind="stable")
        self.lengths = self.width[self.order]
        points = np.frombuffer("".join(words[i] for i in self.order).encode("utf-32-le"), np.uint32)
        self.alphabet, letters = np.unique(points, return_inverse=True)
        self.letters, self.start = letters, np.cumsum(self.lengths) - self.lengths

    def bitsets(self, at: int) -> np.ndarray:
        """For each letter the words that have it at ``at``, 64 in a number."""
        has = np.zeros((len(self.alphabet), -(-len(self.words) // 64) * 64), bool)
        first = int(np.searchsorted(self.lengths, at, side="right"))
        rows = np.arange(first, len(self.words))
        has[self.letters[self.start[first:] + at], rows] = True
        return np.packbits(has, axis=1, bitorder="little").view(np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (a, b) with a and b one replacement apart, or b one letter longer than a."""
        total = len(self.words)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        longest = int(self.lengths[-1]) if total else 0
        blank = np.zeros(-(-total // 64) * 64, bool)

        def of_length(m: int) -> np.ndarray:
            lo, hi = np.searchsorted(self.lengths, [m, m + 1])
            bits = blank.copy()
            bits[lo:hi] = True
            return np.packbits(bits, bitorder="little").view(np.uint64)

        def found(sets: np.ndarray, first: int):
            q, cell = np.nonzero(sets)
            bits = np.unpackbits(sets[q, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            out.append((q[row] + first, cell[row] * 64 + bit))

        none = np.packbits(blank, bitorder="little").view(np.uint64)
        exact = np.tile(~none, (total, 1))      # no error so far; row by row the words being followed, shortest first
        changed = np.tile(none, (total, 1))     # one letter replaced
        inserted = np.tile(~none, (total, 1))   # the other words are one letter ahead
        here, done = self.bitsets(0), 0
        for at in range(longest):
            over = int(np.searchsorted(self.lengths, at, side="right"))
            if over > done:
                found(changed[:over - done] & of_length(at), done)
                found(inserted[:over - done] & of_length(at + 1), done)
                exact, changed, inserted, done = exact[over - done:], changed[over - done:], inserted[over - done:], over
            ahead = self.bitsets(at + 1)
            letter = self.letters[self.start[done:] + at]
            same, shifted = here[letter], ahead[letter]
            changed = (changed & same) | (exact & ~same)
            exact = exact & same
            inserted = (inserted & shifted) | exact
            here = ahead
        if total:
            found(changed & of_length(longest), done)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return self.order[a], self.order[b]

    def result(self) -> pa.RecordBatch:
        a, b = self.pairs()
        # Inside one tile, the shorter word of its size, of its two parts one each, and not of a block of last halves if first halves agree too.
        w = self.words
        keep = (self.group[a] == self.group[b]) & ((self.own[a] != self.own[b]) | ~self.apart[a]) & (self.width[a] == self.size[a])
        a, b = a[keep], b[keep]
        keep = np.array([not bk or w[x][:h] != w[y][:h] for x, y, bk, h in zip(a.tolist(), b.tolist(), self.back[a].tolist(), (self.size[a] // 2).tolist(), strict=True)], bool)
        a, b = a[keep], b[keep]
        # Replacements are found from either word, insertions from the shorter one.
        longer = self.width[b] > self.width[a]
        a, b = np.r_[a, b[longer]], np.r_[b, a[longer]]
        return pa.RecordBatch.from_arrays([pa.array([w[i] for i in a.tolist()], pa.string()), pa.array([w[i] for i in b.tolist()], pa.string()),
                                           pa.array(self.n[b], pa.int64())], ["word", "near", "near_n"])


def _matched(batches: Iterator[pa.RecordBatch], page: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; whole tiles are gathered until there are enough for a page."""
    held: list[pa.RecordBatch] = []
    letters = rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        c = {x: t.column(x).to_numpy() for x in ("size", "block", "i", "j", "own", "n")}
        back = np.array(t.column("back").to_pylist(), bool)
        new = np.r_[True, (np.diff(c["block"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0) | (np.diff(c["size"]) != 0) | (back[1:] != back[:-1])]
        return _Page(t.column("word").to_pylist(), c["n"], np.cumsum(new), back, c["own"], c["i"] != c["j"], c["size"]).result()

    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("size", "block", "back", "i", "j")), strict=True))
        widths = batch.column("size").to_numpy()
        at = 0
        for k, key in enumerate(keys):
            if key != last and (rows >= page or letters >= 32 * page):
                if k > at:
                    held.append(batch.slice(at, k - at))
                yield flush()
                at, rows, letters = k, 0, 0
            last, rows, letters = key, rows + 1, letters + int(widths[k])
        held.append(batch.slice(at))
    if rows:
        yield flush()


def near_words(words: DataFrame, page: int = PAGE, part: int = PART) -> DataFrame:
    """``word, near, near_n`` for all words of ``words`` (word, n; no word twice) that are one error apart, in both directions."""
    tiles = _blocks(words, part)
    # The number of partitions is Spark's; a partition may hold many tiles.
    return tiles.repartition("block", "i", "j").sortWithinPartitions("size", "block", "back", "i", "j").mapInArrow(lambda x: _matched(x, page), PAIRS)


def variants(docs: DataFrame, least: int = 5, ratio: int = 5) -> DataFrame:
    """A row for each word of ``docs``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent near word (of several the smallest) if it has ``ratio`` times the word's n at
    least; ``root`` is where forms lead. Forms grow by that ratio with each step, so halving the way a few
    times ends it; every round is a written table.
    """
    words = materialize(vocabulary(docs, least), "words")
    near = (near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")))
    best = words.join(near, "word", "left").withColumn("likely", -F.col("best.m") >= ratio * F.col("n"))
    known = materialize(best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                    F.when(F.col("likely"), F.col("best.near")).alias("form"),
                                    F.when(F.col("likely"), -F.col("best.m")).alias("form_n")), "forms")
    steps = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        steps = materialize(steps, "roots")
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = steps.join(on, "root")
        if further.isEmpty():
            break
        steps = steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return (known.join(steps, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
