"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; only the bag has a label. Every passage is encoded (a layer
over its features), gated attention gives it a weight, the weighted mean of the encodings represents the
document, and a logistic layer scores it:

    h = tanh(W x),   a = softmax(w . (tanh(V h) * sigmoid(U h))),   score = sigmoid(c . sum(a h) + b)

All layers are learned together from document labels (Adam on the log loss).

Passage features describe form, not topic: shares of 16 character classes, shares of class pairs, word
length, words that repeat their predecessor, words and word triples that the document had before.

Fitting uses at most about ``fit_docs`` labelled documents of each label, with all their passages, and of these
no more than fit into about ``fit_words`` words (of 5 characters) altogether; passages' features alone go to the
driver (some 30 MB at most, whatever the corpus). Scoring encodes every passage of every text.

Defined cases: a null or empty text is one passage without features, and is scored; with no labels every
score is 0.5, with one label only it is that label; a null doc_id is scored; repeated rows are each scored;
an empty table gives no rows; documents with contradicting labels are not learned from.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscope.llm import hashing
from wattscope.llm.common import labelled_sample

PASSAGE_WORDS = 64
CLASSES = 16
FEATURES = CLASSES + CLASSES * CLASSES + 6
_GROUPS = (".", ",", "!", "?", "'\"`", "|", "()[]{}<>", "#$%&*@^~+=", "-_/\\:;")


@cache
def _classes() -> np.ndarray:
    """The class of each code point: lower, upper, digit, blank, line end, other letter, nine groups of marks, other."""
    out = np.full(0x110000, CLASSES - 1, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 0 if s.islower() else 1 if s.isupper() else 5
        elif s.isdigit():
            out[c] = 2
        elif s == "\n":
            out[c] = 4
        elif s.isspace():
            out[c] = 3
    for k, marks in enumerate(_GROUPS, 6):
        out[[ord(m) for m in marks]] = k
    return out


def passages(text: str | None) -> np.ndarray:
    """The features of each passage of a text, a row each; a text without words has one row of zeros."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    kind = _classes()[points]
    blank = (kind == 3) | (kind == 4)
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]][:len(blank)])
    if not len(start):
        return np.zeros((1, FEATURES), np.float32)
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    n = -(-len(start) // PASSAGE_WORDS)
    first = start[::PASSAGE_WORDS]
    of_char = np.zeros(len(kind), np.int64)
    of_char[first[1:]] = 1
    of_char = np.cumsum(of_char)
    of_word = np.arange(len(start)) // PASSAGE_WORDS
    chars = np.bincount(of_char, minlength=n)[:, None]
    words = np.bincount(of_word, minlength=n)[:, None]
    single = np.bincount(of_char * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / chars
    two = of_char[:-1] * CLASSES ** 2 + kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    pairs = np.bincount(two, minlength=n * CLASSES ** 2).reshape(n, -1) / chars

    h = hashing.spans(hashing.prefix(points), start, end)
    triple = h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7) if len(h) > 2 else h[:0]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of_word[len(of_word) - len(flags):], weights=flags, minlength=n)[:, None] / words

    def seen(x: np.ndarray) -> np.ndarray:
        flags = np.ones(len(x), bool)
        flags[np.unique(x, return_index=True)[1]] = False
        return flags

    length = np.bincount(of_word, weights=end - start, minlength=n)[:, None] / words
    inside = seen(h + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([single, pairs, share(h[1:] == h[:-1]), share(seen(h)), share(seen(triple)), share(inside),
                           np.log1p(length), np.log1p(words) / 5], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedAttention:
    """The network above in numpy; bags lie one after the other, ``first`` is where each begins."""

    def __init__(self, features: int, hidden: int = 32, attention: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"W": (features, hidden), "d": (hidden,), "V": (hidden, attention), "U": (hidden, attention),
                  "w": (attention,), "c": (hidden,), "b": ()}
        self.p = {k: rng.normal(size=s) / np.sqrt(s[0]) if len(s) else np.zeros(s) for k, s in shapes.items()}
        self.p["d"] = np.zeros(hidden)
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, sizes = self.p, np.diff(np.r_[first, len(x)])
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["d"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, f: dict, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, sizes = self.p, f["sizes"]
        out = weight * (f["score"] - y) / len(y)
        dz = np.repeat(out[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), sizes))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "d": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "b": out.sum()}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40,
            batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng, ends, step = np.random.default_rng(seed), np.r_[first[1:], len(x)], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(first))
            for at in range(0, len(order), batch):
                part, step = order[at:at + batch], step + 1
                sizes = ends[part] - first[part]
                begin = np.cumsum(sizes) - sizes
                rows = np.repeat(first[part] - begin, sizes) + np.arange(sizes.sum())
                grad = self.gradient(self.forward(x[rows], begin), begin, y[part], weight[part])
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        first = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.forward(np.concatenate(bags).astype(np.float64), first)["score"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = 2500, fit_words: int = 3_000_000) -> GatedAttention | float:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1). A number is a constant score."""
    sample, share = labelled_sample(docs, labels, label, fit_docs)
    if len(share) < 2:
        return float(next(iter(share), 0.5))
    # A number for each document of the sample; texts over the budget of words are left out as a whole.
    long = sample.select("doc_id", F.xxhash64("text").alias("h"), (F.char_length("text") / 5).alias("n")).fillna(0).orderBy("h", "doc_id").collect()
    left, taken_ids = fit_words, set()
    for r in long:
        if r["n"] <= left:
            left -= int(r["n"])
            taken_ids.add((r["doc_id"], r["h"]))
    sample = sample.select("doc_id", "text", "target", F.xxhash64("text").alias("h"))

    def encode(batches):
        for batch in batches:
            batch = batch.filter(pa.array([k in taken_ids for k in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True)], pa.bool_()))
            rows = [passages(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array([r.astype("<f2").tobytes() for r in rows], pa.binary())],
                                             ["doc_id", "target", "bag"])

    got = sample.mapInArrow(encode, "doc_id long, target int, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, "<f2").reshape(-1, FEATURES).astype(np.float32) for b in got.column("bag").to_pylist()]
    y = got.column("target").to_numpy().astype(float)
    taken = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    if not len(y):
        return 0.5
    # The sample has as many of either label; weights bring the true shares back.
    weight = np.array([share[0], share[1]]) / taken
    weight = weight[y.astype(int)] / weight[y.astype(int)].mean()
    model = GatedAttention(FEATURES)
    model.fit(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])]), y, weight)
    return model


def score(docs: DataFrame, model: GatedAttention | float, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the column ``name`` behind all others, which stay; one of that name gives way."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 10,000 numbers

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            model, texts = sent.value, batch.column(text).to_pylist()
            if isinstance(model, float):
                scores = np.full(len(texts), model)
            else:
                scores = np.concatenate([model.score([passages(t) for t in texts[at:at + 32]]) for at in range(0, len(texts), 32)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, schema + f", `{name}` double")


def judged(docs: DataFrame, model: GatedAttention | float, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score``, and ``predicted`` 1 where it is ``least`` at least."""
    return score(docs.drop("predicted"), model).withColumn("predicted", (F.col("score") >= least).cast("int"))
