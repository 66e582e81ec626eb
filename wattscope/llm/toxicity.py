"""Toxicity classifier, counterfactually regularised.

A logistic model over the words of a text, and over the beginnings of words so that inflected forms of a
known insult count too; a feature is present in a text or not. Besides the log loss, learning penalises
how much a score changes when identity terms are swapped: in each sampled sentence that names a group, the
name is replaced by the next one of its kind, and the squared difference of the two logits is added to the
loss. A sentence of every sampled text gets a name besides, put before it, and the next of its kind in place
of that, so that the penalty is at work for groups that no labelled text mentions. So a mention of a group cannot carry weight by itself, whatever the labels say about the sentences in
which it happens to stand, and neutral mentions are not taken for toxic ones.

Only features that labels clearly depend on (chi-squared) become part of the model, so a long clean text
does not add up noise; features of identity terms always do. Copies of a text count once when learning.

Fitting uses at most about ``fit_docs`` labelled documents of each label and keeps ``most_features``
features; pairs that differ in the same features are counted together in the tasks, all of them; scoring reads every word of every text.

Defined cases: a null or empty text, or one without known features, gets the score of none; with no labels,
or labels of one value, the score is that constant (0 without any); a null doc_id is scored; repeated rows
are each scored; an empty table gives no rows; documents with contradicting labels are not learned from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Container, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import labelled_sample, materialize

#: Groups by kind; a term is swapped for the next of its kind. A parameter of ``fit``.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("immigrants", "natives"), ("immigrant", "native"),
    ("african", "european", "american", "arab", "indian", "chinese"),
    ("africans", "europeans", "americans", "arabs", "indians", "chinese"), ("lesbians", "gays", "bisexuals"), ("asians", "latinos"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("mutter", "vater"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("schwule", "lesben", "bisexuelle", "heteros"),
    ("ausländer", "inländer"), ("einwanderer", "einheimische"), ("afrikaner", "europäer", "amerikaner", "araber", "inder", "chinesen"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("madre", "padre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("gais", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "nativos"), ("africanos", "europeos", "americanos", "árabes", "indios", "chinos"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("mère", "père"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("immigrés", "autochtones"), ("africains", "européens", "américains", "arabes", "indiens", "chinois"),
    ("blind", "sighted"), ("deaf", "hearing"), ("disabled", "abled"), ("old", "young"),
)
WORD = re.compile(r"[^\W\d_]+")
#: What is between words, for Arrow: the same characters part them.
NO_WORD = r"[^\p{L}\p{Nl}\p{No}]+"
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6, 7)


def features(words: Iterable[str], whole: Container[str] = ()) -> set[str]:
    """Words, and beginnings of longer words with a hyphen behind, but for words in ``whole``: an identity term
    must not get weight from other words that begin like it."""
    out = set()
    for w in words:
        out.add(w)
        if w not in whole:
            out.update(w[:n] + "-" for n in PREFIXES if len(w) >= n)
    return out


def swapped_pairs(text: str, following: dict[str, str]) -> list[tuple[list[str], list[str]]]:
    """For each identity term of a sentence: features only the original has, and only the one with the next term has."""
    out = []
    for sentence in SENTENCE.findall(text.lower()):
        words = set(WORD.findall(sentence))
        for w in sorted(words & following.keys()):
            a, b = {w}, {following[w]} - words
            out.append((sorted(a), sorted(b)))
    return out


def made_pair(text: str, key: int, kinds: tuple[tuple[str, ...], ...]) -> tuple[list[str], list[str]]:
    """A sentence of the text with a name before it, and with the next of its kind; which, the key tells."""
    words = [WORD.findall(s) for s in SENTENCE.findall(text.lower())] or [[]]
    kind = kinds[key % len(kinds)]
    at = key // len(kinds) % len(kind)
    rest = set(words[key // 97 % len(words)])
    return sorted({kind[at]} - rest), sorted({kind[(at + 1) % len(kind)]} - rest)


class Sparse:
    """Rows of feature numbers, with a value each."""

    def __init__(self, rows: list[list[int]], values: list[list[float]] | None = None):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.array([x for r in rows for x in r], np.int64)
        self.value = np.ones(len(self.at)) if values is None else np.array([x for r in values for x in r])
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def dot(self, w: np.ndarray, seen: np.ndarray | float = 1.0) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at] * self.value * seen, minlength=len(self.sizes))

    def back(self, g: np.ndarray, n: int, seen: np.ndarray | float = 1.0) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row] * self.value * seen, minlength=n)


def learn(x: Sparse, y: np.ndarray, weight: np.ndarray, pairs: Sparse, times: np.ndarray, n: int, counterfactual: float,
          decay: float = 1e-5, steps: int = 800, rate: float = 0.05, keep: float = 0.7) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + counterfactual * mean squared change + decay * |w|^2.

    No weight is negative: no word makes up for an insult. Each step sees a random ``keep`` of the features, so
    an insult gets weight of its own even if it mostly comes with others.
    """
    w, b, rng = np.zeros(n), 0.0, np.random.default_rng(7)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        seen = rng.random(len(x.at)) < keep
        out = weight * (1 / (1 + np.exp(-np.clip(x.dot(w, seen) + b, -30, 30))) - y) / len(y)
        g = x.back(out, n, seen) + decay * w
        if len(pairs.sizes):
            g = g + counterfactual * pairs.back(2 * times * pairs.dot(w) / times.sum(), n)
        g = np.append(g, out.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = 4000, most_features: int = 5000,
        least_docs: int = 3, least_chi2: float = 20.0, counterfactual: float = 5.0,
        identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict | float:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1). A number is a constant score."""
    following = {a: b for kind in identity_terms for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    chosen_docs, share = labelled_sample(docs, labels, label, fit_docs)
    if len(share) < 2:
        return float(next(iter(share), 0.0))

    def encode(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [sorted(features(WORD.findall(t.lower()), following)) for t in texts]
            pairs = [[*swapped_pairs(t, following), made_pair(t, zlib.crc32(str(key).encode()), identity_terms)]
                     for key, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("target"), pa.array(found, pa.list_(pa.string())),
                 pa.array([[p[0] for p in ps] for ps in pairs], pa.list_(pa.list_(pa.string()))),
                 pa.array([[p[1] for p in ps] for ps in pairs], pa.list_(pa.list_(pa.string())))],
                ["doc_id", "target", "found", "lost", "gained"])

    # Four results are taken from the sample; written, so that the documents behind it are read and encoded once.
    encoded = (chosen_docs.groupBy(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), "target").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
               .mapInArrow(encode, "doc_id long, target int, found array<string>, lost array<array<string>>, gained array<array<string>>"))
    sample = materialize(encoded, "toxicity-sample")
    taken = {r[0]: r[1] for r in sample.groupBy("target").count().collect()}
    p, q = taken.get(1, 0), taken.get(0, 0)
    if not p or not q:
        return p / max(1, p + q)
    counts = (sample.select("target", F.explode("found").alias("feature")).groupBy("feature")
              .agg(F.sum("target").alias("a"), F.sum(1 - F.col("target")).alias("b")).where(F.col("a") + F.col("b") >= least_docs))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (p + q) * (a * (q - b) - b * (p - a)) ** 2 / ((a + b) * (p + q - a - b + 1e-9) * p * q)
    chosen = [r[0] for r in counts.withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2)
              .orderBy(F.desc("chi2"), "feature").limit(most_features).collect()]
    number = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *sorted(following)]))}
    # Only numbers of chosen features leave the tasks: bounded by the sample and the number of features.
    kept = sample.select("doc_id", "target", "found")
    # As many as there are different swaps, not mentions.
    swaps = (sample.select(F.explode(F.arrays_zip("lost", "gained")).alias("p")).groupBy("p.lost", "p.gained").agg(F.count(F.lit(1)).alias("times"))
             .orderBy("lost", "gained").collect())

    def narrow(batches):
        n = sent.value
        pick = lambda names: [n[f] for f in names if f in n]
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["target"] for r in rows], pa.int32()), pa.array([pick(r["found"]) for r in rows], pa.list_(pa.int32()))],
                ["target", "found"])

    sent = docs.sparkSession.sparkContext.broadcast(number)
    rows = kept.orderBy("doc_id").mapInArrow(narrow, "target int, found array<int>").collect()
    y = np.array([r["target"] for r in rows], float)
    weight = np.where(y == 1, share[1] / p, share[0] / q)
    pairs = [([number[f] for f in r["lost"] if f in number], [number[f] for f in r["gained"] if f in number]) for r in swaps]
    w, b0 = learn(Sparse([r["found"] for r in rows]), y, weight / weight.mean(),
                  Sparse([[*x, *z] for x, z in pairs], [[1.0] * len(x) + [-1.0] * len(z) for x, z in pairs]), np.array([float(r["times"]) for r in swaps]),
                  len(number), counterfactual)
    return {"weights": {f: float(w[i]) for f, i in number.items()}, "intercept": b0, "pairs": sum(r["times"] for r in swaps),
            "whole": frozenset(following)}


class Scorer:
    """Scores texts, many at once: their words, and the beginnings of them, are looked up together."""

    def __init__(self, model: dict):
        self.intercept, self.whole = model["intercept"], pa.array(sorted(model["whole"]), pa.string())
        names = sorted(model["weights"])
        self.weights = np.array([model["weights"][f] for f in names])
        #: Features that are words (None), or beginnings of so many letters, and their numbers.
        self.known: dict[int | None, tuple[pa.Array, np.ndarray]] = {}
        for n in (None, *PREFIXES):
            own = [i for i, f in enumerate(names) if (None if not f.endswith("-") else len(f) - 1) == n]
            self.known[n] = pa.array([names[i].removesuffix("-") for i in own], pa.string()), np.array(own, np.int64)

    def scores(self, texts: list[str | None]) -> list[float]:
        words = pc.split_pattern_regex(pa.array([(t or "").lower() for t in texts], pa.string()), pattern=NO_WORD)
        row, word = pc.list_parent_indices(words).to_numpy(), words.flatten()
        bare = pc.is_in(word, value_set=self.whole)
        found = []
        for n, (known, number) in self.known.items():
            place = pc.index_in(word if n is None else pc.utf8_slice_codeunits(word, 0, n), value_set=known)
            met = pc.is_valid(place) if n is None else pc.and_not(pc.is_valid(place), bare)
            found.append(row[met.to_numpy(zero_copy_only=False)] * len(self.weights) + number[place.filter(met).to_numpy()])
        # Each feature of a text once, in the order of their names.
        found = np.unique(np.concatenate(found))
        cuts = np.searchsorted(found, np.arange(len(texts) + 1) * len(self.weights)).tolist()
        weights = self.weights[found % max(len(self.weights), 1)].tolist()
        z = [self.intercept + sum(weights[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return [float(1 / (1 + np.exp(-np.clip(x, -500, 500)))) for x in z]

    def __call__(self, text: str | None) -> float:
        return self.scores([text])[0]


def judged(docs: DataFrame, model: dict | float, least: float = 0.7) -> DataFrame:
    """``docs`` with ``score``, and ``predicted`` 1 where it is ``least`` at least; reads column ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``most_features``
    kept = docs.drop("score", "predicted")

    def judge(batches):
        scorer = sent.value if isinstance(sent.value, float) else Scorer(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [scorer] * len(texts) if isinstance(scorer, float) else scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(judge, schema + ", score double").withColumn("predicted", (F.col("score") >= least).cast("int"))
