"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each model sees the text's features and the
probabilities of the categories before it.  In training those probabilities are out-of-fold:
for each fold they come from models fitted on the other folds, so that a later model does not
trust an earlier one more than it will be able to.

Labels may have a flag for each category (``categories``).  Where they have the one flag ``toxic``,
the categories before it are found in the data: the toxic documents of the sample are clustered
by the features that lean to toxic documents, and a category is the flag within one cluster
(``KINDS`` of them, the smaller first).  All features are learned: the words, and their first 3
to 7 letters (once, or shared by several words), that tell labelled documents apart, in any language.

Training reads at most ``max_labelled`` labelled documents, those with the smallest hash of
the id; that bounds what the driver holds.  Scoring runs over whole texts where Spark has
them and moves nothing but probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.store import written

#: Kinds of toxic documents that are looked for where the labels name none.
KINDS = 2
MAX_LABELLED, MAX_FEATURES, FOLDS = 8000, 1200, 3
WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7)
#: A beginning that this many different words of a text share is a feature of its own.
REPEATS = (1, 2, 3)
#: Texts that a worker scores together, and words whose features it remembers.
ROWS, WORDS_KEPT = 256, 100_000


def features_of(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case, and their beginnings with how many share them (``begin*2``)."""
    words = set(WORD.findall((text or "").lower()))
    begun = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return words | {f"{b}*{k}" for b, n in begun.items() for k in REPEATS if n >= k}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 150) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last weight is the bias.

    With one class only, or no rows, the model is that class's smoothed rate.
    """
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    # Both classes weigh the same together, so a rare category is not drowned.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(x.dtype) / len(y)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # the largest curvature, for the step size
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    curvature = 0.25 * float(v @ (x.T @ (weight * (x @ v)))) + l2
    w = np.zeros(x.shape[1], x.dtype)
    ahead, momentum = w, 1.0
    for _ in range(steps):
        gradient = x.T @ (weight * (_sigmoid(x @ ahead) - y)) + l2 * ahead
        new = ahead - gradient / curvature
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w.astype(np.float64)


@dataclass
class Chain:
    """``weights[k]`` is category k's model over the features, the k probabilities before it and the bias."""

    names: list[str]
    features: list[str]
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column a category, from a 0/1 matrix of the features."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, _sigmoid(np.hstack([x, out, np.ones((len(x), 1))]) @ w)[:, None]])
        return out


def fit_chain(x: np.ndarray, features: list[str], labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """Fit the chain on a 0/1 matrix and one 0/1 array a category, in the order of ``labels``."""
    names = list(labels)
    fold = np.arange(len(x)) % folds
    seen = x.astype(np.float32)
    weights = []
    for name in names:
        y = labels[name].astype(np.float32)
        weights.append(fit_linear(seen, y))
        if name == names[-1]:
            break
        held = np.zeros((len(x), 1), np.float32)
        for k in range(folds):
            w = fit_linear(seen[fold != k], y[fold != k])
            held[fold == k, 0] = _sigmoid(np.hstack([seen[fold == k], np.ones((int((fold == k).sum()), 1))]) @ w)
        seen = np.hstack([seen, held])
    return Chain(names, features, weights)


def chosen_features(sample: DataFrame, max_features: int) -> list[str]:
    """The features that differ most between toxic and other documents of the sample.

    Counted where the texts are; only the chosen ones come to the driver.  Few rows can't tell
    many features apart, so there is one for 8 rows at most (and 200 at least).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for f in features_of(text):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            if len(seen) > 200_000:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)

    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n_pos, n_neg = max(1, toxic or 0), max(1, rows - (toxic or 0))
    counts = sample.mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # How much more often, in logarithms, times how often.
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    gain = F.abs(odds) * (F.col("pos") / n_pos + F.col("neg") / n_neg)
    best = counts.where("pos + neg >= 3").orderBy(gain.desc(), "feature").limit(min(max_features, max(200, rows // 8)))
    return [r.feature for r in best.select("feature").collect()]


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    neg, pos = zip(*seen.values(), strict=True) if seen else ((), ())
    return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(neg, pa.int64()), pa.array(pos, pa.int64())], ["feature", "neg", "pos"])


def kinds_of(x: np.ndarray, kinds: int = KINDS, rounds: int = 30) -> np.ndarray:
    """A number from 0 (the smallest cluster) up for each row of a 0/1 matrix: clusters of rows by their features' cosine.

    Rare features weigh more.  Starts from rows that are least alike; the same rows give the same clusters.
    """
    found = x.sum(axis=0)
    rows = x * np.log((len(x) + 1) / (found + 0.5)) if len(x) else x
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    if len(rows) <= kinds:
        return np.arange(len(rows))
    centres = rows[[int((rows @ rows.mean(axis=0)).argmin())]]
    while len(centres) < kinds:
        centres = np.vstack([centres, rows[int((rows @ centres.T).max(axis=1).argmin())]])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(kinds)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    order = np.argsort(np.bincount(own, minlength=kinds), kind="stable")
    return np.argsort(order)[own]


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = (),
    kinds: int = KINDS,
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
) -> Chain:
    """Fit on the labelled documents.

    ``categories`` are 0/1 columns of ``labels`` that come before ``toxic`` in the chain; without any
    they are ``kinds`` clusters.  Null flags and ids are left out (a null category counts as 0), of
    repeated labels the largest counts, and of documents with one id one text, that of the smallest
    hash: the sample has at most ``max_labelled`` rows, whatever the tables repeat.
    """
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"is_{k}") for k, c in enumerate(categories)]
    names = [f"is_{k}" for k in range(len(categories))]
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), *flags)
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), *[F.max(n).alias(n) for n in names])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # The ids are at most ``max_labelled``: small enough to broadcast, so only their texts are shuffled, one an id and task.
    flags = F.array(*names).cast("array<int>")
    sample = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.max(flags).alias("flags"), F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
        .select("doc_id", "toxic", F.col("one.text").alias("text"), "flags"),
        "labelled",
    )
    features = chosen_features(sample, max_features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(features)}
        for batch in batches:
            hits = [sorted(place[f] for f in features_of(t.as_py()) if f in place) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32())), batch.column(3)], ["doc_id", "toxic", "hits", "flags"])

    rows = sample.mapInArrow(encode, "doc_id long, toxic int, hits array<int>, flags array<int>").toArrow()
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "hits", "toxic", "flags")), strict=True))
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (_, hits, _, _) in enumerate(rows):
        x[i, hits] = 1
    toxic = np.array([r[2] for r in rows], np.int64)
    if categories:
        before = {c: np.array([r[3][k] for r in rows], np.int64) for k, c in enumerate(categories)}
    else:
        mine = toxic > 0
        leaning = x[mine].mean(axis=0) > x[~mine].mean(axis=0) if mine.any() and not mine.all() else np.ones(len(features), bool)
        kind = np.full(len(rows), -1)
        kind[mine] = kinds_of(x[mine][:, leaning], kinds)
        before = {f"kind_{k + 1}": (kind == k).astype(np.int64) for k in range(kinds)}
    return fit_chain(x, features, before | {"toxic": toxic})


class Scorer:
    """Scores whole texts; remembers which features a word has a part in."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.words = {f: i for i, f in enumerate(chain.features) if "*" not in f}
        self.begun: dict[str, list[tuple[int, int]]] = {}  # of each beginning, how many words need to share it for which feature
        for i, f in enumerate(chain.features):
            if "*" in f:
                begin, _, k = f.partition("*")
                self.begun.setdefault(begin, []).append((int(k), i))
        self.known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def _word(self, w: str) -> tuple[int, tuple[str, ...]]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        found = self.words.get(w, -1), tuple(w[:n] for n in STEMS if len(w) > n and w[:n] in self.begun)
        self.known[w] = found
        return found

    def features(self, text: str | None) -> list[int]:
        """The places of the chain's features that a text has."""
        out: list[int] = []
        begun: Counter[str] = Counter()
        known = self.known
        for w in set(WORD.findall((text or "").lower())):
            own, begins = known.get(w) or self._word(w)
            if own >= 0:
                out.append(own)
            for b in begins:
                begun[b] += 1
        out += [i for b, n in begun.items() for k, i in self.begun[b] if n >= k]
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A row of probabilities for each text; only a few texts at a time become Python strings."""
        out = [np.zeros((0, len(self.chain.names)))]
        for at in range(0, len(texts), ROWS):
            part = texts.slice(at, ROWS)
            x = np.zeros((len(part), len(self.chain.features)), np.float32)
            for row, t in enumerate(part):
                x[row, self.features(t.as_py())] = 1
            out.append(self.chain.predict(x))
        return np.vstack(out)


def scored(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category of the chain, and ``rejected``; a row for each row.

    A null or wordless text has the probabilities of a text without any feature.  An empty
    table gives an empty result; without labels nothing is rejected.
    """
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(chain)
        for batch in batches:
            p = score(batch.column(1))
            yield pa.record_batch([batch.column(0), *map(pa.array, p.T), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "rejected"])
        pa.default_memory_pool().release_unused()

    fields = ", ".join(["doc_id long", *[f"{n} double" for n in names], "rejected boolean"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows that the chain does not reject, with their columns as they were."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(chain)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(place).cast(pa.string()))[:, -1] < threshold))
        pa.default_memory_pool().release_unused()  # the worker stays for later stages

    return docs.mapInArrow(run, docs.schema)
