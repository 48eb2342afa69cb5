"""Toxicity: a logistic classifier whose scores may not depend on which group is mentioned.

Features of a text are its distinct words (lower case, letters only) and the runs of 4 and of 5 characters in them, their
edges marked, each present or not. All whose share among the toxic texts of the sample lies at least APART standard
deviations from that among all are weighed. Counterfactuals are the sample's texts with each identity term exchanged for
the next one of its kind and language; the squared change of the raw score between a text and its counterfactual is added
to the loss with weight SWAP. So a group's name, however often it stands in texts labelled toxic, gets no weight of its
own, while insults beside it do.

The sample is bounded: of each label the PER_LABEL rows whose ids' hash is smallest, one row an id. Both labels weigh
the same in the loss, so 0.5 lies midway between them however rare one is. A doc_id labelled more than once is toxic if
any of its labels says so.

Null text is empty text and gets the intercept's score. Without labels of both kinds all scores are near the one kind's label, or 0.
Null or repeated doc_ids in documents are rows like others; of rows that repeat a labelled id the first text in order
is learned. Very long texts are scored as a whole. Columns whose names are those of the results are replaced. Empty
tables give empty results.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow

PER_LABEL, APART = 2000, 4.0
#: Weights of the squared change under a swap and of the squared weights; steps of the descent.
SWAP, RIDGE, STEPS = 4.0, 4e-4, 200
#: Group names that may be exchanged for each other, by language and kind (fixed values).
IDENTITY = {
    "en": ["women men", "girls boys", "christians muslims jews hindus buddhists atheists", "gay lesbian straight transgender", "black white asian latino", "immigrants foreigners refugees", "elderly young disabled"],
    "de": ["frauen männer", "mädchen jungen", "christen muslime juden hindus buddhisten atheisten", "schwule lesben heterosexuelle", "schwarze weiße asiaten", "einwanderer ausländer flüchtlinge", "alte junge behinderte"],
    "fr": ["femmes hommes", "filles garçons", "chrétiens musulmans juifs hindous bouddhistes athées", "gays lesbiennes hétérosexuels", "noirs blancs asiatiques", "immigrés étrangers réfugiés", "vieux jeunes handicapés"],
    "es": ["mujeres hombres", "niñas niños", "cristianos musulmanes judíos hindúes budistas ateos", "gays lesbianas heterosexuales", "negros blancos asiáticos", "inmigrantes extranjeros refugiados", "ancianos jóvenes discapacitados"],
}
_WORD = re.compile(r"[^\W\d_]+")
KEPT = 120_000


def features(word: str) -> list[str]:
    marked = f"<{word}>"
    return ["=" + word, *dict.fromkeys(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))]


class Swaps:
    """For each language the term that takes a term's place: the next one of its kind."""

    def __init__(self, groups: dict[str, list[str]]):
        self.by = []
        for kinds in groups.values():
            lists = [k.split() for k in kinds]
            self.by.append({w: ws[(i + 1) % len(ws)] for ws in lists for i, w in enumerate(ws)})

    def __call__(self, words: set[str]) -> set[str] | None:
        """The words with their identity terms exchanged, by the language that has most of them; None if there are none."""
        found = max(self.by, key=lambda by: len(words & by.keys()), default={})
        if not words & found.keys():
            return None
        return {found.get(w, w) for w in words}


class Classifier:
    """Weights of features, by which the words of a text are scored."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def of_words(self, words: set[str], kept: dict[str, tuple[str, ...]]) -> float:
        found: set[str] = set()
        for w in words:
            known = kept.get(w)
            if known is None:
                known = tuple(f for f in features(w) if f in self.weights)
                if len(kept) >= KEPT:
                    kept.clear()
                kept[w] = known
            if known:
                found.update(known)
        return self.intercept + math.fsum(self.weights[f] for f in found)

    def score(self, text: str | None, kept: dict) -> float:
        x = self.of_words(set(_WORD.findall((text or "").lower())), kept)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


class Rows:
    """A matrix of zeros and ones (or minus ones) by its entries, row by row."""

    def __init__(self, rows: list[tuple[list[int], list[int]]], columns: int):
        self.sizes = np.array([len(a) + len(b) for a, b in rows], np.int64)
        self.at = np.fromiter((i for a, b in rows for i in (*a, *b)), np.int64, int(self.sizes.sum()))
        self.sign = np.fromiter((s for a, b in rows for s in [1.0] * len(a) + [-1.0] * len(b)), np.float32, len(self.at))
        self.row, self.columns = np.repeat(np.arange(len(rows)), self.sizes), columns

    def __len__(self) -> int:
        return len(self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.at], len(self))

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.sign * v[self.row], self.columns)

    def norm(self, weight: float | np.ndarray = 1.0) -> float:
        """The largest eigenvalue of the weighted square, by power iteration, a little enlarged."""
        v, size = np.ones(self.columns), 0.0
        for _ in range(30 * bool(len(self))):
            u = self.back(weight * self.times(v))
            size = float(np.linalg.norm(u))
            if not size:
                return 0.0
            v = u / size
        return size * 1.05


def train(texts: list[str], toxic: list[int], swap: float = SWAP, groups: dict[str, list[str]] = IDENTITY, steps: int = STEPS) -> Classifier:
    """Fit by accelerated gradient descent."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Classifier({}, 5.0 if len(y) and y[0] else -5.0)
    # Texts are held as numbers of their words, words as numbers of their features.
    number: dict[str, int] = {}
    bags = [array("i", (number.setdefault(w, len(number)) for w in sorted(set(_WORD.findall(t.lower()))))) for t in texts]
    named: dict[str, int] = {}
    parts = [array("i", (named.setdefault(f, len(named)) for f in features(w))) for w in number]
    del number
    row = lambda bag: np.unique(np.concatenate([np.frombuffer(parts[w], np.int32) for w in bag])) if bag else np.zeros(0, np.int32)
    all_, ones = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
    for bag, t in zip(bags, y, strict=True):
        found = row(bag)
        all_[found] += 1
        if t:
            ones[found] += 1
    n1, n = y.sum(), len(y)
    p = all_ / n
    apart = np.abs(ones / n1 - p) / np.sqrt(p * (1 - p) / n1 + 1e-12)
    kept = (all_ >= max(3, n / 1000)) & (all_ < n) & (apart >= APART)
    column = np.where(kept, np.cumsum(kept) - 1, -1)
    names = [f for f, k in zip(named, kept, strict=True) if k]
    at = {f: i for i, f in enumerate(names)}
    del named
    width, exchanged = len(names) + 1, Swaps(groups)
    rows, changes = [], []
    for text, bag in zip(texts, bags, strict=True):
        mine = column[row(bag)]
        mine = mine[mine >= 0].tolist()
        rows.append(([*mine, width - 1], []))
        if (other := exchanged(set(_WORD.findall(text.lower())))) is not None:
            theirs = {at[f] for w in other for f in features(w) if f in at}
            own = set(mine)
            if own != theirs:
                changes.append((sorted(own - theirs), sorted(theirs - own)))
    x, d = Rows(rows, width), Rows(changes, width)
    ridge = np.full(width, RIDGE)
    ridge[-1] = 0
    weight = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))
    step = 1 / (0.25 * x.norm(weight) + 2 * swap * d.norm() / n + RIDGE)
    w, ahead, t = np.zeros(width), np.zeros(width), 1.0
    for _ in range(steps):
        new = ahead - step * gradient(ahead, x, y, weight, d, swap, ridge)
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (was - 1) / t * (new - w)
        w = new
    return Classifier({f: float(v) for f, v in zip(names, w, strict=False)}, float(w[-1]))


def gradient(w: np.ndarray, x: Rows, y: np.ndarray, weight: np.ndarray, d: Rows, swap: float, ridge: np.ndarray) -> np.ndarray:
    """Of the loss: weighted log loss, swap x the mean squared change of scores under exchanges, and the weights' squares."""
    p = 1 / (1 + np.exp(-np.clip(x.times(w), -50, 50)))
    out = x.back(weight * (p - y)) + ridge * w
    return out + 2 * swap / len(y) * d.back(d.times(w)) if len(d) else out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Classifier:
    """Learn from labels (doc_id, toxic) and the texts of docs."""
    told = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        part = told.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_LABEL)
        picked = part if picked is None else picked.union(part)
    # At most 2 x PER_LABEL ids: small by its bound; one text of each.
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [" ".join(sorted(set(_WORD.findall(t.as_py().lower())))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["y", "at", "words"])

    # A text comes as its distinct words.
    rows = arrow(sample.select("y", F.xxhash64("id").alias("at"), "text"), bags, "y int, at bigint, words string")
    texts, toxic = [], []
    for row in rows.orderBy("at", "words").toLocalIterator():
        texts.append(row.words)
        toxic.append(row.y)
    return train(texts, toxic)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs plus score and predicted (1 if score >= 0.5); columns of these names are replaced."""
    new = ("score", "predicted")
    docs = docs.select([docs[c] for c in docs.columns if c not in new])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields) + "score double, predicted int"
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = Classifier(*sent.value), {}
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                made = [own.score(t.as_py(), kept) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64()), pa.array([int(s >= 0.5) for s in made], pa.int32())], names=[*part.schema.names, *new])

    return arrow(docs, run, schema)
