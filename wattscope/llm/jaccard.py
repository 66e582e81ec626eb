"""N-gram Jaccard join by MinHash banding, and classes of near copies.

1. A text becomes the set of its shingles (five words each, hashed), and the set its name: texts with equal
   sets are one node, whatever their number.
2. Nodes get MinHash values in ``bands`` bands of ``rows`` rows, chosen for a target recall at the
   threshold. Band hashes are shuffled; nodes that share one are candidates, linked through the smallest
   node of the band's group, so a group costs as many rows as it has members. Candidates that hang together
   form a candidate group.
3. Pairs are verified on the full sets, in pieces. A candidate group that fits a block is one piece, and its
   texts travel once. A larger one is cut the cheaper way of two: into blocks of the whole group, every pair of
   blocks a piece, which suits many copies of one text; or into the groups of its bands, where a pair is compared in the
   first band it shares, which suits long chains of texts that are alike only by neighbours. Bands that
   bring the same nodes together count once. So no text moves more often than its bands ask for. Pieces give sums and
   spanning links, never pairs: for each node its number of links, and enough links to connect what is linked.
4. Verified links make the classes.

A pair is found if any band brings it into one group: no cap on partners. In a group cut by blocks, or not at
all, pairs that share no band are found too.

Words are runs of letters and digits in lower case. A text of one to four words has one shingle, all its
words. Defined cases: a text that is null or has no word is alone; a row without doc_id is linked like any
other, and its class is null where no member has an id; a repeated row is linked to its copies; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.llm import hashing
from wattscope.llm.common import materialize
from wattscope.llm.components import connected_components

WORD = re.compile(r"[^\W_]+")
#: Nodes and shingles of a block; a group within them is verified in one piece.
BLOCK_NODES, BLOCK_SHINGLES = 256, 500_000
#: Shingles that are signed at once, about.
SIGNED = 100_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; of all words where there are fewer than ``n``."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    joined = " ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    k = min(n, len(words))
    p = hashing.prefix(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32))
    return np.unique(hashing.spans(p, start[:len(start) - k + 1], end[k - 1:]))


def node_name(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


def banding(threshold: float, recall: float, rows: int | None = None) -> tuple[int, int]:
    """Bands and rows: a pair at ``threshold`` shares a band with probability ``recall`` at least.

    Of the row counts up to 8, the largest that needs at most 24 bands: the more rows, the fewer false candidates.
    """
    needed = {r: ceil(log(1 - recall) / log(1 - threshold ** r)) for r in range(1, 9)}
    rows = rows or max((r for r, b in needed.items() if b <= 24), default=1)
    return needed[rows], rows


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(11)
        self.a = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64)

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each of some non-empty sets a row with one hash for each band. A hash function goes over all sets at once: calls for one set cost more than its shingles."""
        if not sets:
            return np.empty((0, self.bands), np.int64)
        every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        hashed, least = np.empty_like(every), np.empty((len(self.a), len(sets)), np.uint64)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(every, a, out=hashed)
            np.add(hashed, b, out=hashed)
            least[k] = np.minimum.reduceat(hashed, starts)
        least >>= np.uint64(20)  # weak low bits; a shift keeps the order, so it can follow the minimum
        out = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            out = hashing.mix(out + least[r::self.rows].T * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)


def _some(sets: Iterable[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """``sets`` in lists of about ``most`` shingles together."""
    held: list[np.ndarray] = []
    size = 0
    for found in sets:
        held.append(found)
        size += len(found)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, node, size, bands``; node is null for a text without words."""
    def sign(batches):
        hasher = MinHash(bands, rows)
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for sets in _some((shingles(text, n) for text in batch.column("text").to_pylist()), SIGNED):
                signed = iter(hasher.bands_of([found for found in sets if len(found)]))
                out += [(node_name(found), len(found), next(signed)) if len(found) else (None, 0, None) for found in sets]
            yield pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sign, "doc_id long, text_hash long, node binary, size long, bands array<long>")


def similar(sets: list[np.ndarray], threshold: float, split: int | None = None, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets whose Jaccard similarity is ``threshold`` at least; with ``split`` only
    pairs of one set before it and one from it on. Intersections are counted for all pairs, in parts of the shingles."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count[column] > 1  # a shingle of one set alone counts for no pair
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(sets), len(sets)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
            lo, hi = np.searchsorted(column, [at, at + columns])
            part = np.zeros((len(sets), columns), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            both += part @ part.T
    i, j = np.nonzero(np.triu(both, 1))
    if split is not None:
        keep = (i < split) & (j >= split)
        i, j = i[keep], j[keep]
    inside = both[i, j]
    keep = inside >= threshold * (sizes[i] + sizes[j] - inside) - 1e-9
    return i[keep], j[keep]


def not_met_before(bands: np.ndarray, place: int) -> np.ndarray:
    """For each pair of nodes (rows of ``bands``) whether it shares none of the bands before ``place``."""
    out = np.ones((len(bands), len(bands)), bool)
    for column in bands.T[:place]:
        out &= column[:, None] != column[None, :]
    return out


def _verified(rows: list[dict], n: int, threshold: float) -> Iterator[tuple]:
    """(node, links, other): counts for each node of a piece, and links that span what is linked."""
    left = {r["node"]: r for r in rows if r["side"] == 0}
    right = {r["node"]: r for r in rows if r["side"] == 1}
    chosen = [*left.values(), *right.values()]
    whole = rows[0]["x"] == rows[0]["y"]
    if len(chosen) < 2 or not whole and not (left and right):
        return
    split, fresh = len(left), None
    if rows[0]["place"] > 0:  # of a band: nodes whose pairs have all met in an earlier one need no comparison
        fresh = np.triu(not_met_before(np.array([r["bands"] for r in chosen]), rows[0]["place"]), 1)
        if not whole:
            fresh[split:], fresh[:, :split] = False, False
        use = np.flatnonzero(fresh.any(axis=0) | fresh.any(axis=1))
        if not len(use):
            return
        chosen, fresh, split = [chosen[k] for k in use], fresh[np.ix_(use, use)], int((use < split).sum())
    sets = [shingles(r["text"], n) for r in chosen]
    i, j = similar(sets, threshold, None if whole else split)
    if fresh is not None:
        i, j = i[fresh[i, j]], j[fresh[i, j]]
    times = np.array([r["times"] for r in chosen])
    links = np.bincount(i, weights=times[j], minlength=len(chosen)) + np.bincount(j, weights=times[i], minlength=len(chosen))
    root = list(range(len(chosen)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joined = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            root[b] = a
            joined.append((x, y))
    for k in np.flatnonzero(links).tolist():
        yield chosen[k]["node"], int(links[k]), None
    for x, y in joined:
        yield chosen[x]["node"], 0, chosen[y]["node"]


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row: the smallest doc_id of its class, and how many other rows
    are linked to it (similarity of the threshold at least, exact copies included). ``how``: see ``classify``."""
    return classify(docs, **how).select("doc_id", "class_id", "n_links")


def _blocks(nodes: str, total: str) -> Column:
    return F.greatest(F.ceil(F.col(nodes) / BLOCK_NODES), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")


def _pieces(nodes: DataFrame, shared: DataFrame, met: DataFrame, groups: DataFrame) -> DataFrame:
    """``node, unit, place, blocks``: the units each candidate is verified in, cut into so many blocks. A unit is a
    candidate group (``place`` -1) or, where fewer texts move that way, the group of a band (its place)."""
    large = materialize(groups.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
                        .withColumn("blocks", _blocks("n", "total")).where("blocks > 1"), "large-groups")
    # Bands with the same nodes are one: of these the first counts.
    kept = (met.groupBy("n", "total", "f1", "f2").agg(F.min(F.struct("place", "band", "a")).alias("first"))
            .select("first.*", "n", _blocks("n", "total").alias("blocks")))
    by_band = (kept.join(groups.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum(F.col("n") * F.col("blocks")).alias("moved")))
    # Both have a row for each large group only; few enough to be sent along by Spark, else a join like any other.
    routed = materialize(large.join(by_band, "component").select("component", "blocks", (F.col("moved") < F.col("n") * F.col("blocks")).alias("by_band")), "routes")
    routes = groups.join(routed, "component", "left")
    units = routes.where(~F.coalesce("by_band", F.lit(False))).select(
        "node", F.col("component").alias("unit"), F.lit(-1).alias("place"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    if routed.where("by_band").isEmpty():
        return units
    of_bands = (routes.where("by_band").select("node").join(shared.select("node", "band"), "node")
                .join(kept.select("band", "place", "blocks"), "band"))
    return units.unionByName(of_bands.select("node", F.unhex(F.hex("band")).alias("unit"), "place", "blocks"))


def classify(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """For each row ``doc_id``, a hash of its text, its ``node`` (null: no words), ``class_id``, ``n_links``, and whether it is
    the row that ``stays`` of its class: the smallest doc_id (none counts last), of rows with the same one the smallest hash."""
    bands, rows = banding(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = materialize(signed.where("node is not null").groupBy("node")
                        .agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("times"), F.max("size").alias("size"), F.min("bands").alias("bands")), "nodes")
    banded = nodes.select("node", "size", F.posexplode("bands").alias("place", "band"))
    # Two independent hashes, added without carry, tell which bands bring the same nodes together.
    met = materialize(banded.groupBy("band").agg(
        F.min("node").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("place").alias("place"),
        F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f2")).where("n > 1"), "bands")
    shared = materialize(banded.select("node", "band").join(met.select("band", "a"), "band"), "meetings")
    # A node is linked to the smallest node it meets, and that one to the smallest of each of the node's bands:
    # the same groups with about one link a node, where many near copies share many bands. At most ``bands`` a node.
    own = shared.groupBy("node").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    links = own.select("a", F.col("node").alias("b")).union(own.select("a", F.explode("others").alias("b"))).where("a <> b").distinct()
    groups = connected_components(links)

    chosen = groups.join(nodes, "node")
    of_row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    least = chosen.select("node", F.col("least.doc_id").alias("rep_id"), F.col("least.text_hash").alias("rep_hash"))
    # Equal rows are one before anything moves: with no id, or a repeated one, a text may come any number of times.
    texts = (of_row.join(least, of_row["doc_id"].eqNullSafe(least["rep_id"]) & (of_row["text_hash"] == least["rep_hash"]))
             .groupBy("node").agg(F.min("text").alias("text")))
    pieces = (_pieces(nodes, shared, met, groups).join(nodes.select("node", "times", "bands"), "node")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("unit", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                      F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "node", "times", "place",
                      F.when(F.col("place") > 0, F.col("bands")).alias("bands"), "text"))

    def verify(batches):
        held: list[dict] = []
        out: list[tuple] = []

        def batch_of():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                                              ["node", "links", "other"])

        for batch in batches:
            for row in batch.to_pylist():
                key = row["unit"], row["x"], row["y"]
                if held and key != (held[0]["unit"], held[0]["x"], held[0]["y"]):
                    out.extend(_verified(held, n, threshold))
                    held = []
                held.append(row)
                if len(out) > 10_000:
                    yield batch_of()
        out.extend(_verified(held, n, threshold) if held else ())
        if out:
            yield batch_of()

    keys = ["unit", "x", "y"]
    found = materialize(pieces.repartition(*keys).sortWithinPartitions(*keys, "side", "node")
                        .mapInArrow(verify, "node binary, links long, other binary"), "links")
    classes = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "least", "times").join(linked, "node", "left").join(classes, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(smallest, "component").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    alone = signed.where("node is null").select("doc_id", "text_hash", "node", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                                F.lit(True).alias("stays"))
    return signed.where("node is not null").join(named, "node").select(
        "doc_id", "text_hash", "node", F.col("first.doc_id").alias("class_id"), "n_links", stays.alias("stays")).unionByName(alone)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class; rows with the same doc_id and text are one; of rows without doc_id, those without
    words all stay, since nothing tells whether they are copies."""
    told = (classify(docs, **how).where("node is not null and (not stays or doc_id is null)")
            .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_told"), F.col("stays").alias("_stays")).distinct())
    # As one column, so that no name of a document's column meets one of these.
    hashed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_hash"))
    kept = hashed.join(told, hashed["_own"].eqNullSafe(told["_id"]) & (hashed["_hash"] == told["_told"]), "left").where("coalesce(_stays, true)")
    known = F.col("_own").isNotNull() | F.col("_stays").isNotNull()
    return kept.where(known).dropDuplicates(["_own", "_hash"]).select("doc.*").unionByName(kept.where(~known).select("doc.*"))
