"""Packing of documents into training sequences as vector bin packing.

Every sequence has three limits at once: tokens, segments (pieces), and loss-bearing tokens. Sequences are
filled one after the other from a pool of waiting items. Of the items that fit whole, the one whose demand
vector has the largest dot product with what the sequence has left goes in: a sequence with much room takes
long items, one whose loss budget is almost spent takes items that bear little loss. When nothing fits
whole, the best item is cut so that the sequence is full. A sequence that cannot be filled (input at its
end, or another limit reached first) keeps its largest power of two of tokens, and the rest goes back to
the pool, so no sequence needs padding.

Each task packs the items of its own partition, with a pool of bounded size: no shuffle, nothing gathered.
Sequence ids carry the partition number, so they are unique and come out the same when a lost task is run
again over the same input split.

Defined cases: a null text is an empty one, which has only the end id; a null doc_id stays null; repeated
rows are packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")
#: Bits of a sequence id left for the number within the partition.
LOCAL_BITS = 40


@dataclass(frozen=True)
class Limits:
    """A sequence's limits, and the number of items that wait while one is chosen."""

    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096
    pool_items: int = 256


class Packer:
    """Packs a stream of items; ``add`` and ``finish`` give finished sequences as lists of pieces."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.items: list[list] = []  # [key, ids, running loss, start]
        self.tok = np.zeros(limits.pool_items + 1, np.int64)
        self.loss = np.zeros(limits.pool_items + 1, np.int64)

    def add(self, key, ids: np.ndarray, bears_loss: np.ndarray | None = None) -> Iterator[list[tuple]]:
        run = None if bears_loss is None else np.concatenate([[0], np.cumsum(bears_loss, dtype=np.int64)])
        if len(ids):
            self._put([key, ids, run, 0])
        while len(self.items) >= self.limits.pool_items:
            yield self._sequence()

    def finish(self) -> Iterator[list[tuple]]:
        while self.items:
            yield self._sequence()

    def _put(self, item: list) -> None:
        self.items.append(item)
        if len(self.items) > len(self.tok):
            self.tok, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tok, self.loss))
        self._weigh(len(self.items) - 1)

    def _weigh(self, i: int) -> None:
        _, ids, run, start = self.items[i]
        self.tok[i] = len(ids) - start
        self.loss[i] = len(ids) - start if run is None else run[-1] - run[start]

    def _take(self, i: int, n: int) -> tuple:
        """The first ``n`` tokens of what is left of item ``i``; the item goes when nothing is left."""
        key, ids, run, start = self.items[i]
        piece = (key, ids, run, start, n)
        if start + n == len(ids):
            last = self.items.pop()
            if i < len(self.items):
                self.items[i] = last
                self.tok[i], self.loss[i] = self.tok[len(self.items)], self.loss[len(self.items)]
        else:
            self.items[i][3] = start + n
            self._weigh(i)
        return piece

    def _sequence(self) -> list[tuple]:
        lim = self.limits
        room_t, room_s, room_l = lim.tokens, lim.segments, lim.loss_tokens
        pieces: list[tuple] = []
        while room_t and room_s and self.items:
            n = len(self.items)
            tok, loss = self.tok[:n], self.loss[:n]
            score = (tok * (room_t / lim.tokens ** 2) + room_s / lim.segments ** 2
                     + loss * (room_l / max(lim.loss_tokens, 1) ** 2))
            fits = (tok <= room_t) & (loss <= room_l)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                length = int(tok[i])
            else:
                i = int(np.argmax(score))
                length = min(int(tok[i]), room_t)
                _, _, run, start = self.items[i]
                if run is None:
                    length = min(length, room_l)
                else:
                    length = min(length, int(np.searchsorted(run, run[start] + room_l, side="right")) - 1 - start)
                if length <= 0:
                    break
            piece = self._take(i, length)
            pieces.append(piece)
            run = piece[2]
            room_t, room_s = room_t - length, room_s - 1
            room_l -= length if run is None else int(run[piece[3] + length] - run[piece[3]])
        if not pieces:
            raise ValueError("the limit on loss-bearing tokens must let at least one of them in")
        return self._whole(pieces)

    def _whole(self, pieces: list[tuple]) -> list[tuple]:
        """The pieces cut to the largest power of two where they do not fill the sequence."""
        total = sum(p[4] for p in pieces)
        if total < self.limits.tokens:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                key, ids, run, start, n = pieces.pop()
                back = min(over, n)
                over -= back
                if n > back:
                    pieces.append((key, ids, run, start, n - back))
                self._give_back(key, ids, run, start + n - back, back)
        out, offset = [], 0
        for key, ids, run, start, n in pieces:
            borne = n if run is None else int(run[start + n] - run[start])
            out.append((key, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), self.next_id, offset, borne))
            offset += n
        self.next_id += 1
        return out

    def _give_back(self, key, ids, run, start, n) -> None:
        """Tokens cut off an unfilled sequence: joined to the item's waiting rest, or waiting by themselves."""
        for i, item in enumerate(self.items):
            if item[1] is ids and item[3] == start + n:
                item[3] = start
                self._weigh(i)
                return
        self._put([key, ids, run, start])


def _pieces(items: Iterator[tuple], limits: Limits) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits, TaskContext.get().partitionId() << LOCAL_BITS)
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        rows.clear()
        return batch

    for key, ids, loss in items:
        for sequence in packer.add(key, ids, loss):
            rows += sequence
        if len(rows) >= 10_000:
            yield flush()
    for sequence in packer.finish():
        rows += sequence
        if len(rows) >= 10_000:
            yield flush()
    if rows:
        yield flush()


def pack(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Packs items that are tokens already: ``doc_id``, ``ids`` array<int>, and, where the frame has it,
    ``loss`` array<int> of the same length, 1 for tokens that bear loss (without it all of them do).

    Rows with null or empty ``ids`` give no piece; a null or shorter ``loss`` bears none where it is missing.
    """
    with_loss = "loss" in items.columns

    def stream(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"] or [], "<u4")
                loss = None
                if with_loss:
                    loss = np.zeros(len(ids), np.int64)
                    given = [x or 0 for x in (row["loss"] or [])[:len(ids)]]
                    loss[:len(given)] = given
                yield row["doc_id"], ids, loss

    chosen = items.select("doc_id", "ids", *(["loss"] if with_loss else []))
    return chosen.mapInArrow(lambda b: _pieces(stream(b), limits), PIECES)


#: A single full stop or comma after a letter and before a blank is a token of its own in any case.
TAIL = re.compile(r"([.,])(?<=[^\W\d_][.,])(?= )")


class WordCache:
    """Token ids of texts, by words: no token of this vocabulary reaches over a blank, so a text's ids are
    its words' ids one after the other, and each distinct word is tokenized once in a worker. When
    ``most_words`` are known, the later half is forgotten: frequent words come early.

    Capital sigma is left to the tokenizer with its whole text: its lower case depends on its neighbours
    in Python but not in the tokenizer.
    """

    def __init__(self, tokenizer_json: str, most_words: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.most_words = most_words
        # The usual naming of bytes: printable ones by themselves, the others by characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in plain]
        self.byte_names = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(hidden)}
        self.place: dict[str, int] = {"": 0}
        #: Where the ids of each word begin in ``flat``, and where the last one ends.
        self.bounds = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 16, "<u4")

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of lower-case letters alone: it is one token to the splitter, so only its bytes, each
        written as the character that stands for it in the vocabulary, are left to merge."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_names)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2048):
            part = words[at:at + 2048]
            got = [self._letters(w) if w.isalpha() and is_normalized("NFC", w) else None for w in part]
            other = iter(self.tokenizer.encode_batch_fast([w for w, ids in zip(part, got, strict=True) if ids is None], add_special_tokens=False))
            got = [next(other).ids if ids is None else ids for ids in got]
            n = len(self.place)
            ends = self.bounds[n] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
            while n + len(got) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.bounds[n]:ends[-1]] = np.fromiter(chain.from_iterable(got), "<u4")
            self.bounds[n + 1:n + 1 + len(got)] = ends
            self.place.update(zip(part, range(n, n + len(got)), strict=True))

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, ``end`` after them."""
        if len(self.place) > self.most_words:
            self.place = dict(islice(self.place.items(), self.most_words // 2))
        split: list[tuple[list[str], np.ndarray] | None] = []
        new: dict[str, None] = {}
        for text in texts:
            if "Σ" in text or "<|" in text:
                split.append(None)
                continue
            words = TAIL.sub(r" \1", text.lower().replace("\n", " ")).split(" ")
            at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
            new.update((words[i], None) for i in np.flatnonzero(at < 0).tolist())
            split.append((words, at))
        self._learn(list(new))
        out = []
        for text, found in zip(texts, split, strict=True):
            if found is None:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                words, at = found
                for i in np.flatnonzero(at < 0).tolist():
                    at[i] = self.place[words[i]]
                first = self.bounds[at]
                n = self.bounds[at + 1] - first
                ends = np.cumsum(n)
                ids = self.flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
            out.append(np.append(ids, np.array([end], "<u4")))
        return out


#: By the digest of the vocabulary: a worker may serve several.
_CACHES: dict[bytes, WordCache] = {}


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:
    """Tokenizes ``doc_id, text`` and packs in the same task; ``end_id`` follows every document."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    digest, vocabulary = hashlib.sha256(text.encode()).digest(), spark.sparkContext.broadcast(text)  # one vocabulary file: a few MB whatever the data

    def stream(batches):
        cache = _CACHES.get(digest) or _CACHES.setdefault(digest, WordCache(vocabulary.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), cache.encode(texts, end_id), strict=True):
                yield key, ids, None

    return docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(stream(b), limits), PIECES)

