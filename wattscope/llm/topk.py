"""Exact top-k search by inner product: distributed histogram selection.

Queries are taken in blocks of bounded size; the candidates stay where they are. For a block, every task
scores its candidates against all queries of the block and counts scores in equal bins of each query's
current range. The histograms, summed over all tasks, tell in which bin the k-th score lies; that bin is the
next range, until a bin is one integer wide and the k-th score is known exactly. A last pass keeps the
scores above it and, of those equal to it, the smallest ids that are still needed. Scores are never
stored or shuffled, only bin counts and the few final rows.

A task sends only the bins from the top down to where its own candidates alone make up k: the k-th score of
all cannot lie lower. Its rows are at most k for each query, whatever the number of candidates or equal
vectors, and nothing is lost. Ties are reduced in the same way.

Vectors hold integers here (see ``integer_vectors``), and arithmetic is exact: in doubles where no sum can
reach 2^53, else in Python's integers, with scores held to the range of a long.

Defined cases: rows with a null id, a null vector, or a component that is null or not finite take no part;
shorter vectors count as zero where they end; an id that repeats stays as many candidates, and as a query
stands for its smallest vector; rows with the query's id are never its results; no queries or no
candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscope.llm.common import new_folder

BINS = 1024
#: Queries of a block; with their components they are sent to every task.
BLOCK = 2048
#: Scores held at once in a task.
CELLS = 4_000_000
HIGH = (1 << 63) - 1


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component, as longs, of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite))
            .select(F.col(key).cast("long").alias("vec_id"),
                    F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, cut or filled with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at[1] < width
    out[at[0][inside], at[1][inside]] = flat[inside]
    return out


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``c`` and rows of ``q``; exact, held to the range of a long."""
    top = int(max(abs(int(c.min(initial=0))), int(c.max(initial=0)))) * max(abs(int(q.min(initial=0))), int(q.max(initial=0)))
    if top * max(1, q.shape[1]) < 1 << 53:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    exact = c.astype(object) @ q.T.astype(object)
    return np.clip(exact, -HIGH, HIGH).astype(np.int64) if exact.size else exact.astype(np.int64)


class Block:
    """A block of queries, and for each of them the range [low, low + span) that holds its k-th score."""

    def __init__(self, rows: list, k: int, largest: int):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.q = np.zeros((len(rows), max((len(r["v"]) for r in rows), default=0)), np.int64)
        for i, r in enumerate(rows):
            self.q[i, :len(r["v"])] = r["v"]
        # No score is farther from zero than the query's components and the largest candidate component allow.
        reach = [min(HIGH, sum(abs(x) for x in v) * largest) for v in self.q.tolist()]
        self.low = np.array([-r for r in reach], np.int64)
        self.span = np.array([2 * r + 1 for r in reach], np.uint64)
        self.need = np.full(len(rows), k, np.int64)
        self.done = np.zeros(len(rows), bool)  # the k-th score is ``low``, or
        self.all = np.zeros(len(rows), bool)  # there are fewer candidates than k, and every score is kept

    @property
    def width(self) -> np.ndarray:
        return (self.span - np.uint64(1)) // np.uint64(BINS) + np.uint64(1)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates' ids, their scores by query, and which of these are of other rows than the query's own."""
        most, ids, parts = max(1, CELLS // max(1, len(self.ids))), [], []

        def out():
            c, keys = np.concatenate(parts), np.concatenate(ids)
            ids.clear(), parts.clear()
            return keys, _scores(c, self.q), keys[:, None] != self.ids[None, :]

        for batch in batches:
            keys, m = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), self.q.shape[1])
            for at in range(0, len(keys), most):
                ids.append(keys[at:at + most])
                parts.append(m[at:at + most])
                if sum(map(len, ids)) >= most:
                    yield out()
        if ids:
            yield out()

    def histogram(self, batches) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        counts, width = np.zeros(n * BINS, np.int64), self.width
        for _, s, other in self.scored(batches):
            # Differences are taken as unsigned: a range may be wider than a long.
            above = s.astype(np.uint64) - self.low.astype(np.uint64)
            inside = (s >= self.low) & (above < self.span) & other & ~self.done
            bins = (above // width).astype(np.int64) + np.arange(n) * BINS
            counts += np.bincount(bins[inside], minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        before = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts  # of higher bins
        i, b = np.nonzero((counts > 0) & (before < self.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, b, counts[i, b], self.need[i])], ["i", "bin", "n", "need"])

    def results(self, batches) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def prune():
            i, s, key = np.concatenate(kept, axis=1)
            order = np.lexsort((key, -s, i))
            i, s, key = i[order], s[order], key[order]
            tie = (s == self.low[i]) & ~self.all[i]
            run = np.arange(len(i)) - np.maximum.accumulate(np.where(np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])], np.arange(len(i)), 0))
            keep = ~tie | (run < self.need[i])
            kept[:] = [np.stack([i, s, key])[:, keep]]

        held = 0
        for keys, s, other in self.scored(batches):
            c, i = np.nonzero(((s >= self.low) | self.all) & other)
            kept.append(np.stack([i, s[c, i], keys[c]]))
            held += len(i)
            if held > 500_000:
                prune()
                held = kept[0].shape[1]
        if kept:
            prune()
            i, s, key = kept[0]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.ids[i], key, s)], ["query_id", "vec_id", "score"])

    def refine(self, found: dict[int, tuple[int, int]]) -> bool:
        """Takes the bin of each k-th score, and the count above it, as the new range; whether all are known."""
        width = self.width
        for i in np.flatnonzero(~self.done).tolist():
            if i not in found:
                self.all[i] = self.done[i] = True
                continue
            b, above = found[i]
            self.low[i] = int(self.low[i]) + b * int(width[i])
            self.need[i] -= above
            self.span[i] = width[i]
            self.done[i] = width[i] == 1
        return bool(self.done.all())


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The ``k`` best candidates of each row for which ``is_query`` holds: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id long, v array<long>``. Ties go to the smaller ``vec_id``.
    """
    spark = vectors.sparkSession
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    ends = vectors.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    largest = max(abs(x or 0) for x in ends)
    path, blocks = new_folder(spark, "topk"), -(-n // block)
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    down = Window.partitionBy("i").orderBy(F.desc("bin"))
    for b in range(blocks):
        part = Block(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect(), k, largest)
        while True:
            sent = spark.sparkContext.broadcast(part)
            counts = (vectors.mapInArrow(lambda x, sent=sent: sent.value.histogram(x), "i long, bin long, n long, need long")
                      .groupBy("i", "bin", "need").agg(F.sum("n").alias("n")))
            upto = counts.withColumn("upto", F.sum("n").over(down)).where("upto >= need and upto - n < need")
            found = {r["i"]: (r["bin"], r["upto"] - r["n"]) for r in upto.collect()}
            sent.destroy()
            if part.refine(found):
                break
        sent = spark.sparkContext.broadcast(part)
        (vectors.mapInArrow(lambda x, sent=sent: sent.value.results(x), "query_id long, vec_id long, score long")
         .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)
