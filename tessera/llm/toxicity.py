"""Toxicity by a classifier chain.

The categories are predicted one after another by logistic models over hashed words, word beginnings and coarse
marks of a text. Each model also sees the probabilities that the models before it gave. In training these are
out-of-fold predictions: a document's earlier probabilities come from models that were fitted
without it, so that later models learn from the kind of input that they will meet.

The labels hold one mark, `toxic`. The chain's earlier categories are kinds of abuse, marked where a toxic document
has a word of a short fixed list (weak labels); the last category is `toxic` itself, and it alone decides.

The chain is fitted on at most `most` labelled documents, chosen by a hash of doc_id; all documents are scored
in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts
from .linear import fit_logistic, fit_platt, labelled_sample, matrix, pick_features, short, sigmoid, text_features
from .store import set_aside

#: Words that mark a kind of abuse in a document labelled toxic.
KINDS = {
    "insult": ["idiot", "moron", "stupid", "clown"],
    "demeaning": ["loser", "worthless", "pathetic"],
    "contempt": ["trash", "scum", "disgusting"],
}
TARGET = "toxic"
MOST, FEATURES, FOLDS = 3000, 1500, 4


@dataclass
class Link:
    """One category's model: weights over `features`, then over the earlier links' probabilities, then the intercept."""

    name: str
    features: np.ndarray
    weights: np.ndarray


@dataclass
class Chain:
    links: list[Link]
    slope: float
    intercept: float

    def score(self, found: np.ndarray) -> list[float]:
        """Probability of each category; the last is calibrated."""
        chances: list[float] = []
        for link in self.links:
            z = link.weights[-1] + float(np.dot(link.weights[len(link.features) : -1], chances))
            if len(link.features):
                at = np.minimum(np.searchsorted(link.features, found), len(link.features) - 1)
                z += float(link.weights[at[link.features[at] == found]].sum())
            chances.append(float(sigmoid(np.float64(z))))
        return [*chances[:-1], float(sigmoid(np.float64(self.slope * z + self.intercept)))]


def _fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    features = pick_features(rows, y, most)
    return features, fit_logistic(np.hstack((matrix(rows, features), earlier.astype(np.float32))), y, penalty=0.5)


def fit_chain(rows: list[np.ndarray], marks: dict[str, np.ndarray], fold: np.ndarray, most: int = FEATURES) -> Chain:
    """A chain over the categories in the order of marks."""
    earlier = np.zeros((len(rows), 0))
    links = []
    z = np.zeros(len(rows))
    for name, y in marks.items():
        z = np.zeros(len(rows))
        for k in np.unique(fold):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            features, w = _fit([rows[i] for i in train], y[train], earlier[train], most)
            z[test] = np.hstack((matrix([rows[i] for i in test], features), earlier[test])) @ w[:-1] + w[-1]
        links.append(Link(name, *_fit(rows, y, earlier, most)))
        earlier = np.column_stack((earlier, sigmoid(z)))
    return Chain(links, *(fit_platt(z, marks[name]) if len(rows) else (1.0, 0.0)))


def train(docs: DataFrame, labels: DataFrame, kinds: dict[str, list[str]] = KINDS, most: int = MOST, features: int = FEATURES, folds: int = FOLDS) -> Chain | None:
    """The chain, or None if the labels don't hold both classes."""
    sample = labelled_sample(docs, labels, [TARGET], most)
    toxic = sample[TARGET].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return None
    rows = list(sample["features"])
    marks = {}
    for kind, words in kinds.items():
        keys = short(np.concatenate([H.words(w) for w in words]))
        marks[kind] = toxic & np.array([np.isin(keys, r).any() for r in rows])
    fold = (H.mix(sample["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(folds)).astype(int)
    return fit_chain(rows, {k: m for k, m in marks.items() if m.any()} | {TARGET: toxic}, fold, features)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, kinds: dict[str, list[str]] = KINDS, most: int = MOST, keep: bool = False) -> DataFrame:
    """Per row of docs: doc_id, p_<category> for each kind, p_toxic, and is_toxic: p_toxic >= threshold (with all columns of docs, if keep).

    Null and empty texts are scored on their looks alone. If the labels don't hold both classes, nothing is toxic and all
    probabilities are 0; the same holds for a kind that no labelled document has. Equal rows get equal scores. An empty
    table gives an empty one.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, kinds, most))
    names = [*kinds, TARGET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain.value
        at = {link.name: i for i, link in enumerate(model.links)} if model else {}
        for batch in parts(batches):
            scores = [model.score(text_features(t.as_py())) if model else [] for t in batch.column("text")]
            columns = [pa.array([s[at[n]] if n in at else 0.0 for s in scores], pa.float64()) for n in names]
            toxic = pa.array([bool(model) and s[-1] >= threshold for s in scores], pa.bool_())
            own = [c for c in batch.schema.names if keep or c == "doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *columns, toxic], [*own, *(f"p_{n}" for n in names), "is_toxic"])

    source = docs if keep else docs.select("doc_id", "text")
    kinds_of = ", ".join(f"`{c}` {k}" for c, k in source.dtypes if keep or c == "doc_id")
    return source.mapInArrow(run, kinds_of + "".join(f", p_{n} double" for n in names) + ", is_toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the chain rejects; all columns stay."""
    plain, back = set_aside(docs)
    return back(score_toxicity(plain, labels, threshold, keep=True).where(~F.col("is_toxic")))
