"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, by another rotation and another shift for each curve, and ordered
along a Hilbert curve of the projection: near vectors tend to have near keys, and pairs that one curve tears
apart another keeps together. Every ordering is range-partitioned and sorted by Spark; positions along it are
counted in parts. A query meets the vectors at most ``window`` positions before and after it, cut into blocks
of bounded size, so no group grows with the data. Vectors travel along the curves as packed numbers of their
own width: a block is ranked by a matrix product first, and what can be among its best by exact distances; what
the curves find is merged.

Equal vectors are one node with its smallest ``k + 1`` ids, which is all that any result can name; so a vector
that a third of all rows share costs one place on a curve. Rotations, shifts and the cells of the curves are
fitted on a sample of about ``FIT_ROWS`` vectors. The window is fitted too: for about ``FIT_QUERIES`` queries
the exact neighbours are found by a scan, and the window is the distance on the curves within which the share
``recall`` of them lies. It follows the data: few positions where vectors have structure, many where they have
none (then curves save little over a scan), but not below ``LEAST``, so that a small table is searched whole.

Defined cases: vectors that are null, empty or zero, or hold null or not finite components, and rows without
vec_id take no part; a row that repeats counts once; an id with several vectors is a candidate and a query with
each of them, results of the query are the nearest of all; missing components of shorter vectors are zero; no
queries or no candidates give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscope.llm.common import materialize

CURVES, DIMS, BITS = 16, 8, 7
FIT_ROWS, FIT_QUERIES = 4096, 96
BLOCK = 4096
#: The smallest window that is fitted.
LEAST = 256
#: Exact distances computed at once in a task.
PAIRS = 1 << 16


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points given by rows of ``cells``, each below 2^bits.

    From the highest bit down, the lower bits of the axes are mirrored or swapped as the curve turns; what is
    left is a Gray code over the bits of all axes, which running parities decode.
    """
    axes = [c.astype(np.uint64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i, axis in enumerate(axes):
            up = (axis >> np.uint64(level)) & np.uint64(1) == 1
            swap = np.where(up, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    key, parity = np.zeros(len(cells), np.uint64), np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            parity = parity ^ ((axis >> np.uint64(level)) & np.uint64(1))
            key = (key << np.uint64(1)) | parity
    return key.astype(np.int64)


class Curves:
    """The projections and their cells; small, and sent to every task."""

    def __init__(self, sample: np.ndarray, width: int, curves: int, dims: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.bits, dims = width, bits, min(dims, width)
        self.maps = []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(width, dims)))[0]
            seen = sample @ turn
            low, high = (seen.min(axis=0), seen.max(axis=0)) if len(seen) else (np.zeros(dims), np.ones(dims))
            side = np.maximum((high - low) * 1.5, 1e-300)
            self.maps.append((turn, low - rng.uniform(0.1, 0.4, size=dims) * side / 1.5, (1 << bits) / side))

    def keys(self, m: np.ndarray) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        with np.errstate(over="ignore", invalid="ignore"):
            cells = [np.clip(np.nan_to_num(np.floor((m @ turn - low) * scale)), 0, top).astype(np.int64) for turn, low, scale in self.maps]
        return [hilbert_keys(c, self.bits) for c in cells]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


def _packed(m: np.ndarray, kind: str) -> pa.Array:
    width = m.shape[1] * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * width).astype(np.int32)), pa.py_buffer(m.astype(kind).tobytes())])


def _unpacked(vectors: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T)
    return np.where(np.isnan(d), np.inf, np.maximum(d, 0))


def _nearest(q: np.ndarray, c: np.ndarray, asked: np.ndarray, nodes: np.ndarray, first: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` nearest rows of ``c`` for each of ``q`` by exact distance, ties to the smaller ``first``."""
    rough = _squares(q, c)
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(c) else np.full(len(q), np.inf)
    with np.errstate(over="ignore"):
        # More than the product can be wrong by.
        limit = limit + 1e-9 * ((q * q).sum(axis=1) + (c * c).sum(axis=1).max())
    i, j = np.nonzero(rough <= limit[:, None])
    score = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        with np.errstate(over="ignore"):
            score[part] = np.sqrt(((q[i[part]] - c[j[part]]) ** 2).sum(axis=1))
    order = np.lexsort((first[j], score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pa.RecordBatch.from_arrays([pa.array(asked[i[keep]]), pa.array(nodes[j[keep]]), pa.array(first[j[keep]]), pa.array(score[keep])], ["asked", "node", "first", "score"])


def usable(df: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """``vec_id, v, h, q``: the rows that take part, components as doubles, a hash of them, and whether it is a query."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    return (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0))
            .select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("h", F.xxhash64("v")))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: ``node, v, h, ids`` (the k + 1 smallest) and whether a query has it (``asks``)."""
    same = Window.partitionBy("h", "v")
    first = (rows.drop("q").distinct().withColumn("place", F.row_number().over(same.orderBy("vec_id")))
             .where(F.col("place") <= k + 1))
    ids = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("q").select(F.col("h").alias("qh"), F.col("v").alias("qv")).distinct()
    met = ids.join(asked, (ids["h"] == asked["qh"]) & (ids["v"] == asked["qv"]), "left")
    return materialize(met.select(F.monotonically_increasing_id().alias("node"), "v", "h", "ids", F.col("qh").isNotNull().alias("asks")), "nodes")


def _ordered(nodes: DataFrame, curves: Curves, kind: str) -> DataFrame:
    """``curve, pos, node, first, asks, packed``: the nodes along every curve, positions counted through all curves."""
    sent = nodes.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), sent.value.width)
            for c, key in enumerate(sent.value.keys(m)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(key), *(b.column(x) for x in ("node", "first", "asks")), _packed(m, kind)],
                                                 ["curve", "key", "node", "first", "asks", "packed"])

    along = (nodes.select("node", F.col("ids")[0].alias("first"), "asks", "v").mapInArrow(keyed, "curve int, key long, node long, first long, asks boolean, packed binary")
             .repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node"))
    # The id counts rows of a partition from its number times 2^33.
    laid = materialize(along.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "curves")
    # A row for each partition; written, so that its size is known before the join is planned.
    parts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return laid.join(materialize(parts.select("part", "before"), "parts"), "part").select(
        "curve", (F.col("before") + F.expr("row & 8589934591")).alias("pos"), "node", "first", "asks", "packed")


def _fitted_window(nodes: DataFrame, ordered: DataFrame, width: int, k: int, recall: float, n_asked: int) -> int:
    """The distance along the curves within which the share ``recall`` of sampled queries' exact neighbours lies."""
    share = int(min(1.0, FIT_QUERIES / max(1, n_asked)) * 1_000_000)
    picked = nodes.where(F.col("asks") & (F.pmod(F.xxhash64("h", F.lit("fit")), F.lit(1_000_000)) < share)).select("node", "v").limit(2 * FIT_QUERIES).collect()
    if not picked:
        return LEAST
    q, of = np.zeros((len(picked), width)), np.array([r["node"] for r in picked], np.int64)
    for i, r in enumerate(picked):
        q[i, :len(r["v"])] = r["v"]
    sent = nodes.sparkSession.sparkContext.broadcast((of, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, q = sent.value
        for b in batches:
            if b.num_rows:
                yield _nearest(q, _matrix(b.column("v"), width), of, b.column("node").to_numpy(), b.column("first").to_numpy(), k + 1)

    best = Window.partitionBy("asked").orderBy("score", "first", "node")
    exact = (nodes.select("node", F.col("ids")[0].alias("first"), "v").mapInArrow(scan, "asked long, node long, first long, score double").where("asked <> node")
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("asked", "node").collect())
    known = nodes.sparkSession.createDataFrame([(x,) for x in sorted({x for r in exact for x in r} | set(of.tolist()))], "node long")
    at: dict[int, dict[int, int]] = {}
    for r in ordered.join(F.broadcast(known), "node").select("node", "curve", "pos").collect():
        at.setdefault(r["node"], {})[r["curve"]] = r["pos"]
    apart = sorted(min(abs(p - at[r["node"]][c]) for c, p in at[r["asked"]].items()) for r in exact)
    return max(LEAST, apart[min(len(apart) - 1, int(recall * len(apart)))] + 1) if apart else LEAST


def _met(batches: Iterator[pa.RecordBatch], keep: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come by block, candidates before queries; a block's candidates are held, queries pass by in batches."""
    block, held, c = None, [], None
    for b in batches:
        blocks, asks = b.column("block").to_numpy(), np.array(b.column("asks").to_pylist(), bool)
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if blocks[lo] != block:
                block, held, c = blocks[lo], [], None
            part = b.slice(lo, hi - lo)
            if not asks[lo]:
                held.append(part)
            elif held:
                if c is None:
                    t = pa.Table.from_batches(held)
                    c = _unpacked(t.column("packed").to_pylist(), kind), t.column("node").to_numpy(), t.column("first").to_numpy()
                yield _nearest(_unpacked(part.column("packed").to_pylist(), kind), c[0], part.column("node").to_numpy(), c[1], c[2], keep)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, curves: int = CURVES,
           window: int | None = None, recall: float = 0.95, dims: int = DIMS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest found of each row for which ``is_query`` holds: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance. ``window`` positions on both sides of a query are searched on each
    curve; without it the window is fitted for the share ``recall`` (see above).
    """
    spark = df.sparkSession
    rows = usable(df, is_query, key, vector)
    nodes = _nodes(rows, k)
    n, width, n_asked = nodes.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asks")).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = int(min(1.0, FIT_ROWS / n) * 1_000_000)
    seen = nodes.where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1_000_000)) <= share).select("v").limit(2 * FIT_ROWS).collect()
    sample = np.zeros((len(seen), width))
    for i, r in enumerate(seen):
        sample[i, :len(r["v"])] = r["v"]
    kind = "<f4" if df.select(vector).schema[0].dataType.elementType.typeName() == "float" else "<f8"
    ordered = _ordered(nodes, Curves(sample, width, curves, dims, bits), kind)
    if window is None:
        window = _fitted_window(nodes, ordered, width, k, recall, n_asked)
    size = max(64, min(block, window))
    moved = ("node", "first", "packed")
    # A block is of one curve.
    placed = ordered.select(F.expr(f"pos div {size}").alias("part"), F.lit(False).alias("asks"), "curve", *moved)
    asking = ordered.where("asks").select(F.explode(F.sequence(F.expr(f"greatest(pos - {window}, 0) div {size}"), F.expr(f"(pos + {window}) div {size}"))).alias("part"),
                                          F.lit(True).alias("asks"), "curve", *moved)
    found = (placed.union(asking).select((F.col("part") * curves + F.col("curve")).alias("block"), "asks", *moved).repartition("block").sortWithinPartitions("block", "asks")
             .mapInArrow(lambda x: _met(x, k + 1, kind), "asked long, node long, first long, score double"))
    nearest = Window.partitionBy("asked").orderBy("score", "first", "node")
    near = found.distinct().withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    ranked = materialize(near.join(nodes.select("node", "ids"), "node").select("asked", "score", "ids"), "near")
    # Queries by their node; equal ones share what was found.
    own = rows.where("q").distinct()
    at = nodes.where("asks").select("node", F.col("h").alias("nh"), F.col("v").alias("nv"))
    named = own.join(at, (own["h"] == at["nh"]) & (own["v"] == at["nv"])).select(F.col("vec_id").alias("query_id"), "node")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    every = (named.join(ranked, named["node"] == ranked["asked"]).select("query_id", "score", F.explode("ids").alias("vec_id"))
             .where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
