"""Removal of repeated text by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in another document or
in the same one. Strings never cross documents.

1. Every window of ``length`` bytes belongs to the anchor inside it: its smallest hashed k-gram (leftmost of
   equal ones), so equal windows have equal anchors at the same place. An anchor's windows are neighbours: it
   is a row (document, place, first and last window, hash of the k-gram, BLAKE2 digest of all its windows' bytes).
2. Anchors whose k-gram occurs once are done: nothing repeats there. Anchors alike in all their windows are
   one class, counted before the shuffle, however many copies there are; windows of a class with two members
   or more are repeated.
3. Classes with the same k-gram but different surroundings are cut into pieces, one member each: windows that
   have the anchor at about the same place. All windows of a piece hold its core, so only pieces with equal
   cores can hold equal windows; of pieces equal in all bytes one is kept. Where a core is crowded, its pieces
   are cut once more, so that a k-gram, passage or line that very many documents have is spread over tasks.
4. Pieces with the same core but different surroundings meet in a task, with their bytes.
   Their windows are suffixes, sorted by a merge sort in which two suffixes are compared by the length of
   their common extension, found by binary search over prefix polynomial hashes: logarithmic, whatever the
   length. Neighbours with ``length`` bytes in common are repeated. What all neighbours have in common, and
   with it the order, is verified on the bytes; after a collision the sort is done again with another base and
   other numbers for the bytes.
   A core with more than ``most_classes`` different pieces is not brought to one task: its windows are counted
   by a BLAKE2 digest over all tasks, which gives the same answer.
5. Repeated windows go back to all members of their class, and each document is cut once.

Texts travel compressed, by document, and anchors as a few numbers; no step gathers a group of copies.

Defined cases: a null text is empty; a text shorter than ``length`` stays whole; repeated rows are documents
of their own, so a long enough text that is repeated goes altogether; rows without doc_id are treated like
any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscope.llm import hashing
from wattscope.llm.common import materialize

SEGMENT = 4 << 20
#: Windows sorted at once in a task, and bytes of their texts.
CHUNK = 600_000
TEXTS = 2 << 20
#: Bytes compared at once.
STRETCH = 500_000
#: A core with more pieces than this is cut finer.
CROWD = 100
NO_ID = -(1 << 63)
LOW32 = np.uint64(0xFFFFFFFF)


def digest(data: bytes) -> bytes:
    """Stands for the bytes where they are not compared themselves: texts can be made whose polynomial hashes are equal."""
    return blake2b(data, digest_size=16).digest()


def anchors(data: bytes, length: int, gram: int) -> Iterator[tuple]:
    """at, lo, hi, g, c of the anchors of a text; a long text is taken in overlapping segments."""
    for begin in range(0, len(data) - length + 1, SEGMENT):
        x = np.frombuffer(data, np.uint8, min(len(data) - begin, SEGMENT + length - 1), begin)
        p = hashing.prefix(x)
        _, inverse = hashing.powers(len(p))
        n = len(x) - gram + 1
        g = hashing.mix((p[gram:] - p[:-gram]) * inverse[:n])
        # Smallest k-gram of each run: minima from block borders forward and backward.
        run = length - gram + 1
        keys = np.full(-(-n // run) * run, np.iinfo(np.uint64).max, np.uint64)
        keys[:n] = (g & ~LOW32) | np.arange(n, dtype=np.uint64)
        blocks = keys.reshape(-1, run)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(x) - length + 1
        place = (np.minimum(behind[:windows], ahead[run - 1:run - 1 + windows]) & LOW32).astype(np.int64)
        lo = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
        hi = np.r_[lo[1:], windows] - 1
        at = place[lo]
        c = [digest(data[a:b]) for a, b in zip((lo + begin).tolist(), (hi + begin + length).tolist(), strict=True)]
        yield at + begin, lo + begin, hi + begin, g[at].view(np.int64), c


class Collision(Exception):
    """Two different strings had one hash."""


class Suffixes:
    """Windows of several texts as suffixes of one buffer, compared by hashed common extensions."""

    def __init__(self, texts: list[bytes], length: int, base: int):
        self.length = length
        self.first = np.cumsum([0, *(len(t) for t in texts)])
        # Behind the last text there is room for a comparison that reaches its end.
        self.bytes = np.frombuffer(b"".join(texts) + bytes(length + 1), np.uint8)
        # A retry puts random numbers for the bytes: some strings are alike with every base.
        self.p = hashing.prefix(hashing.mix(np.arange(256, dtype=np.uint64) + np.uint64(base << 8))[self.bytes] if base else self.bytes, base)
        self.inverse = hashing.powers(len(self.p), base)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` have in common, ``length`` at most."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        pa_, pb, ia, ib = self.p[a], self.p[b], self.inverse[a], self.inverse[b]
        for _ in range(self.length.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.p[a + mid] - pa_) * ia == (self.p[b + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        return (n < self.length) & (self.bytes[a + n] < self.bytes[b + n])

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order of suffixes ``at``, each bucket (equal values side by side) sorted for itself.

        Bottom-up merge sort: every element finds its place in the neighbouring run by binary search.
        """
        begin = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]
        size = np.diff(np.r_[begin, len(at)])
        start, end = np.repeat(begin, size), np.repeat(begin + size, size)
        order, width = np.arange(len(at)), 1
        while width < size.max(initial=0):
            i = np.flatnonzero(end - start > width)
            k = (i - start[i]) // width
            own = start[i] + k * width
            other = np.where(k % 2 == 0, own + width, own - width)
            lo = np.minimum(other, end[i])
            hi = np.minimum(other + width, end[i])
            first, mine = lo.copy(), at[order[i]]
            while (open_ := lo < hi).any():
                j = np.flatnonzero(open_)
                mid = (lo[j] + hi[j]) >> 1
                theirs = at[order[mid]]
                # Of equal ones those of the left run come first.
                left = k[j] % 2 == 0
                before = np.where(left, self.less(theirs, mine[j]), ~self.less(mine[j], theirs))
                lo[j], hi[j] = np.where(before, mid + 1, lo[j]), np.where(before, hi[j], mid)
            place = np.minimum(own, np.where(other < end[i], other, own)) + (i - own) + (lo - first)
            merged = order.copy()
            merged[place] = order[i]
            order, width = merged, width * 2
        return order

    def verify(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Raises Collision unless the windows at ``a`` and ``b`` have just ``n`` bytes in common and that at ``a`` is the smaller
        one, if not equal; each byte of a stretch is compared once."""
        if not len(a):
            return
        d = np.flatnonzero(n < self.length)
        if (self.bytes[a[d] + n[d]] >= self.bytes[b[d] + n[d]]).any():
            raise Collision
        order = np.lexsort((a, b - a))
        a, n, shift = a[order], n[order], (b - a)[order]
        # How far neighbours with the same shift have been compared already.
        room = np.cumsum(np.r_[0, shift[1:] != shift[:-1]]) * len(self.bytes)
        reach = np.maximum.accumulate(a + n + room)
        start = np.maximum(a, np.r_[0, reach[:-1] - room[1:]])
        size = np.maximum(a + n - start, 0)
        upto = np.cumsum(size)
        cuts = np.searchsorted(upto, np.arange(STRETCH, upto[-1], STRETCH))
        for part in np.split(np.arange(len(a)), cuts):
            i = np.repeat(part, size[part])
            at = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            if (self.bytes[at] != self.bytes[at + shift[i]]).any():
                raise Collision


def repeated_windows(members: list[tuple], length: int) -> list[np.ndarray]:
    """For each member (group, place of its anchor, number of windows, bytes), whether each window occurs in
    another member of its group."""
    count = np.array([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), count)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    group = np.unique([m[0] for m in members], return_inverse=True)[1]
    place = np.array([m[1] for m in members])
    bucket = group[owner] * (length + 1) + place[owner] - index
    by_bucket = np.argsort(bucket, kind="stable")
    owner, index, bucket = owner[by_bucket], index[by_bucket], bucket[by_bucket]
    hit = np.zeros(len(owner), bool)
    for base in range(len(hashing.BASES)):
        suffixes = Suffixes([m[3] for m in members], length, base)
        at = suffixes.first[owner] + index
        order = suffixes.sort(at, bucket)
        a, b = at[order[:-1]], at[order[1:]]
        near = np.flatnonzero(bucket[order[:-1]] == bucket[order[1:]])
        n = suffixes.common(a[near], b[near])
        equal = near[n == length]
        try:
            suffixes.verify(a[near], b[near], n)
        except Collision:
            continue
        hit[order[equal]] = hit[order[equal + 1]] = True
        flags = np.zeros(len(owner), bool)
        flags[by_bucket] = hit
        return np.split(flags, np.cumsum(count)[:-1])
    raise RuntimeError("collisions with every base")


def _ranges(flags: np.ndarray) -> list[dict]:
    """Runs of true flags as first and last index."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


RANGES = "g long, c binary, ranges array<struct<a:int,b:int>>"
_RANGES = pa.schema([("g", pa.int64()), ("c", pa.binary()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def contested(classes: DataFrame) -> DataFrame:
    """One member of each class whose k-gram has other classes too."""
    # A written table, like that of repeated k-grams: one side that is aggregated in the same stage would keep a hot k-gram in one task.
    several = materialize(classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "several")
    return classes.join(several, "g").select("g", "c", "classes", "one.*")


def sorted_windows(members: DataFrame, length: int, most_classes: int) -> DataFrame:
    """``g, c, ranges``: the windows of each member that another member of its group has too, by the suffix sort."""
    def settle(batches):
        held: list[tuple] = []
        windows = size = 0

        def out():
            flags = repeated_windows([m[:4] for m in held], length)
            rows = [{"g": m[0], "c": m[4], "ranges": _ranges(f)} for m, f in zip(held, flags, strict=True) if f.any()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, _RANGES)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "place", "windows", "bytes", "c")), strict=True):
                if held and (held[-1][0], held[-1][4]) == (row[0], row[4]):
                    continue
                if (windows > CHUNK or size > TEXTS) and held[-1][0] != row[0]:
                    yield out()
                    windows = size = 0
                held.append(row)
                windows += row[2]
                size += len(row[3])
        if held:
            yield out()

    sorted_ = members.where(F.col("classes") <= most_classes).repartition("g").sortWithinPartitions("g", "c").mapInArrow(settle, RANGES)
    return sorted_.unionByName(_counted(members.where(F.col("classes") > most_classes), length))


def pieces(members: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """The windows of each member, ``width`` places of the anchor together, with the hash of their core and the digest of all their bytes."""
    def split(batches):
        for batch in batches:
            rows = []
            for g, c, place, windows, data in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "place", "windows", "bytes")), strict=True):
                for k in range((place - windows + 1) // width, place // width + 1):
                    near, far = k * width, min((k + 1) * width, length - gram + 1) - 1
                    first, last = max(place - far, 0), min(place - near, windows - 1)
                    core = blake2b(data[place - near:place - far + length], digest_size=8).digest()
                    rows.append((g, c, first, place - first, last - first + 1, int.from_bytes(core, "little", signed=True), digest(data[first:last + length])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return members.select("g", "c", "place", "windows", "bytes").mapInArrow(split, PIECES)


PIECES = "of_g long, of_c binary, first int, place int, windows int, g long, c binary"
_PIECES = pa.schema([("of_g", pa.int64()), ("of_c", pa.binary()), ("first", pa.int32()), ("place", pa.int32()), ("windows", pa.int32()),
                     ("g", pa.int64()), ("c", pa.binary())])


def shared_windows(members: DataFrame, length: int, gram: int, widths: tuple[int, ...], most_classes: int) -> DataFrame:
    """As ``sorted_windows``, with several rows of a member: only what has a core in common is sorted, crowded cores in finer pieces."""
    every = materialize(pieces(members, length, gram, widths[0]), "pieces")
    own = F.struct("of_g", "of_c", "first", "place", "windows")
    # A member can be there twice, which is no repetition.
    kinds = materialize(every.groupBy("g", "c").agg(F.min(own).alias("one"), (F.min(own) != F.max(own)).alias("again")), "kinds")
    texts = members.select(F.col("g").alias("of_g"), F.col("c").alias("of_c"), "bytes")
    cuts = materialize(contested(kinds).join(texts, ["of_g", "of_c"])
                       .select("g", "c", "place", "windows", "classes", F.expr(f"substring(bytes, first + 1, windows + {length - 1})").alias("bytes")), "cuts")
    if widths[1:]:
        crowded = F.col("classes") > CROWD
        found = sorted_windows(cuts.where(~crowded), length, most_classes).unionByName(
            shared_windows(cuts.where(crowded), length, gram, widths[1:], most_classes))
    else:
        found = sorted_windows(cuts, length, most_classes)
    found = materialize(found, "found")
    whole = kinds.where("again").select("g", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.windows") - 1).alias("b"))).alias("ranges"))
    repeated = whole.unionByName(found.join(kinds.where("not again").select("g", "c"), ["g", "c"]))
    return every.join(repeated, ["g", "c"]).select(
        F.col("of_g").alias("g"), F.col("of_c").alias("c"),
        F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 96, most_classes: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, removed`` (array of start, end in bytes, maximal runs) and ``kept`` (what remains, binary)."""
    text = F.coalesce(docs["text"], F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"),
                        F.xxhash64(text).alias("k2"))

    def find(batches):
        for batch in batches:
            for k1, k2, value in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for found in anchors(value.encode(), length, gram):
                    n = len(found[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), *(pa.array(x.astype(np.int32)) for x in found[:3]), pa.array(found[3]), pa.array(found[4], pa.binary())],
                        ["k1", "k2", "at", "lo", "hi", "g", "c"])

    long_enough = named.where(F.octet_length("text") >= length)
    every = materialize(long_enough.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, at int, lo int, hi int, g long, c binary"), "anchors")
    # A written table, so that both sides of the join are plain shuffles and a hot k-gram's anchors can be split.
    again = materialize(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "again")
    occurring = materialize(every.join(again, "g"), "occurring")
    classes = materialize(occurring.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one")), "classes")

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = [squeeze.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(out, pa.binary())],
                                             [*(c for c in batch.schema.names if c != "text"), "z"])

    def cut_out(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, wanted in zip(batch.column("z").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = expand.decompress(z)
                rows += [(w["g"], w["c"], w["at"] - w["lo"], w["hi"] - w["lo"] + 1, data[w["lo"]:w["hi"] + length]) for w in wanted]
            for at in range(0, len(rows), 2000):
                columns = zip(*rows[at:at + 2000], strict=True)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["g", "c", "place", "windows", "bytes"])

    wanted = contested(classes).groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "c", "at", "lo", "hi")).alias("wanted"))
    # A repeated row brings its text twice; one is enough.
    texts = long_enough.select("k1", "k2", "text").mapInArrow(packed, "k1 long, k2 long, z binary")
    members = materialize(texts.join(wanted, ["k1", "k2"]).select("z", "wanted")
                          .mapInArrow(cut_out, "g long, c binary, place int, windows int, bytes binary"), "members")

    run = length - gram + 1
    alone = materialize(shared_windows(members, length, gram, (-(-run // 8), max(1, run // 128)), most_classes), "ranges")
    whole = classes.where("n > 1").select("g", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b"))).alias("ranges"))
    repeated = whole.unionByName(alone.join(classes.where("n = 1").select("g", "c"), ["g", "c"]))
    spans = (occurring.join(repeated, ["g", "c"]).select("k1", "k2", F.explode("ranges").alias("r"), "lo")
             .select("k1", "k2", F.struct((F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.b") + length).alias("end")).alias("span"))
             .groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")))

    def cut(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans")), strict=True):
                data, removed = expand.decompress(z) if z else b"", []
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    if removed and s["start"] <= removed[-1]["end"]:
                        removed[-1]["end"] = max(removed[-1]["end"], s["end"])
                    else:
                        removed.append(dict(s))
                edges = [0, *(x for s in removed for x in (s["start"], s["end"])), len(data)]
                rows.append({"doc_id": doc_id, "n_bytes": len(data), "removed": removed,
                             "kept": b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))})
            yield pa.RecordBatch.from_pylist(rows, _CUT)

    joined = named.mapInArrow(packed, "doc_id long, k1 long, k2 long, z binary").join(spans, ["k1", "k2"], "left")
    return joined.select("doc_id", "z", "spans").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                  ("kept", pa.binary())])


def _counted(members: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of k-grams with very many classes: windows counted by their digest."""
    def windows(batches):
        for batch in batches:
            for g, c, n, data in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "windows", "bytes")), strict=True):
                h = pa.array([digest(data[j:j + length]) for j in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array([c] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), h], ["g", "c", "j", "h"])

    def merged(batches):
        for batch in batches:
            rows = []
            for g, c, js in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "js")), strict=True):
                flags = np.zeros(max(js) + 1, bool)
                flags[js] = True
                rows.append({"g": g, "c": c, "ranges": _ranges(flags)})
            yield pa.RecordBatch.from_pylist(rows, _RANGES)

    every = materialize(members.dropDuplicates(["g", "c"]).mapInArrow(windows, "g long, c binary, j int, h binary"), "windows")
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return every.join(again, "h").groupBy("g", "c").agg(F.collect_list("j").alias("js")).mapInArrow(merged, RANGES)
