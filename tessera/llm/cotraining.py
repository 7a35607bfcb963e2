"""Quality by co-training on two views of a document.

One view is the text (hashed words, word beginnings, coarse looks), the other the page's metadata (source, language,
length class and their pairs). A classifier a view starts from the labelled documents. Each round,
either view's classifier scores all unlabelled documents in one distributed pass and marks those that it is surest of, in the
classes' proportions, and the marks go to the other view's training set only. Scores of both views are then calibrated on labelled
documents that took no part in the fit, and the calibrated log-odds are combined by a last
logistic model, fitted on further such documents, in which no view counts against its own verdict. Features of all documents are computed once and written; every pass reads them.

Labelled documents (`most` at most) are chosen by a hash of doc_id. A round's marks are a share of `pool` (or of the unlabelled
documents, if those are fewer), whatever the number of documents they are chosen from. Both are parameters of the fit alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts, small_batches
from .linear import fit_logistic, fit_platt, matrix, pick_features, short, sigmoid, text_features
from .store import hash_sample, written

MOST, POOL, FEATURES = 6000, 4000, 1500
ROUNDS, SHARE, SURE = 4, 0.05, 0.9
META = ["source", "lang", "n_chars"]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashes of the metadata's values and of their pairs."""
    size = "none" if n_chars is None else str(int(2 * np.log2(max(1, n_chars))))
    facts = [f"source={source}", f"lang={lang}", f"size={size}", f"{source}/{lang}", f"{lang}/{size}"]
    return short(np.concatenate([H.spans(H.prefix_sums(d), np.array([0]), np.array([len(d)])) for d in (np.frombuffer(f.encode(), np.uint8) for f in facts)]))


@dataclass
class View:
    features: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[-1] + self._sum(r) for r in rows])

    def _sum(self, found: np.ndarray) -> float:
        if not len(self.features):
            return 0.0
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return float(self.weights[at[self.features[at] == found]].sum())

    def raw_column(self, column: pa.ListArray) -> np.ndarray:
        """raw() of a column of features, without an object a row."""
        found, sums = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.zeros(1)
        if len(self.features) and len(found):
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            sums = np.concatenate((sums, np.cumsum(np.where(self.features[at] == found, self.weights[at], 0.0))))
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        ends = np.minimum(ends, len(sums) - 1)
        return self.weights[-1] + sums[ends[1:]] - sums[ends[:-1]]

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.raw(rows) + self.intercept


@dataclass
class Scorer:
    text: View
    meta: View
    weights: np.ndarray

    def score(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, metadata, combined) probabilities of quality."""
        return self.combined(self.text.odds(text), self.meta.odds(meta))

    def score_columns(self, text: pa.ListArray, meta: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score() of columns of features."""
        a, b = (view.slope * view.raw_column(c) + view.intercept for view, c in ((self.text, text), (self.meta, meta)))
        return self.combined(a, b)

    def combined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def _fit(rows: list[np.ndarray], y: np.ndarray, most: int) -> View:
    features = pick_features(rows, y, most)
    return View(features, fit_logistic(matrix(rows, features), y, penalty=0.5))


#: A mark: the document's key, its label and its features in both views.
Mark = tuple[int, bool, tuple[np.ndarray, np.ndarray]]


class Listed:
    """Unlabelled documents in memory."""

    def __init__(self, views: tuple[list[np.ndarray], list[np.ndarray]]) -> None:
        self.views, self.size = views, len(views[0])

    def best(self, fitted: list[View], taken: list[set[int]], wanted: dict[bool, int], sure: float) -> list[list[Mark]]:
        """Per view, the free documents that it is surest of: at most `wanted` a label."""
        out: list[list[Mark]] = [[], []]
        for v in (0, 1):
            p = sigmoid(fitted[v].raw(self.views[v]))
            for label, chance in ((True, p), (False, 1 - p)):
                order = [int(i) for i in np.lexsort((np.arange(len(p)), -chance)) if chance[i] >= sure and int(i) not in taken[v]]
                out[v] += [(i, label, (self.views[0][i], self.views[1][i])) for i in order[: wanted[label]]]
        return out


class Distributed:
    """All unlabelled documents of a table of features, scored where they lie; only the marks come to the driver."""

    def __init__(self, table: DataFrame, labels: DataFrame, most: int) -> None:
        self.rows = table.where("doc_id is not null")
        self.known = labels.where("quality is not null and doc_id is not null").select("doc_id").distinct()
        self.size = min(most, self.rows.join(self.known, "doc_id", "left_anti").count())

    def best(self, fitted: list[View], taken: list[set[int]], wanted: dict[bool, int], sure: float) -> list[list[Mark]]:
        """Per view, the free documents that it is surest of: at most `wanted` a label, each doc_id once."""
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast((fitted, [np.array(sorted(t), np.int64) for t in taken]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, gone = shared.value
            for batch in parts(batches):
                ids = batch.column("key").to_numpy(zero_copy_only=False)
                p = [pa.array(sigmoid(view.raw_column(batch.column(c))), mask=np.isin(ids, none)) for view, c, none in zip(views, ("text", "meta"), gone, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), *p], ["key", "hash", "p0", "p1"])

        found = self.rows.select(F.col("doc_id").cast("long").alias("key"), "hash", "text", "meta").mapInArrow(run, "key long, hash long, p0 double, p1 double")
        sides = [F.struct(F.lit(v).alias("v"), F.lit(label).alias("label"), (p if label else 1 - p).alias("chance")) for v, p in enumerate((F.col("p0"), F.col("p1"))) for label in (True, False)]
        found = found.select(F.col("key").alias("doc_id"), "hash", F.inline(F.array(*sides))).where(F.col("chance") >= sure)
        found = found.join(self.known, "doc_id", "left_anti")  # numbers, no features
        found = found.groupBy("v", "label", "doc_id").agg(F.max(F.struct("chance", "hash")).alias("_b")).select("v", "label", "doc_id", "_b.*")
        order = Window.partitionBy("v", "label").orderBy(F.desc("chance"), "doc_id")
        # A literal limit: each task sends that many of a view and label at most.
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(wanted.values()))
        marks = best.where(F.col("rank") <= F.when(F.col("label"), wanted[True]).otherwise(wanted[False])).collect()
        if not marks:
            return [[], []]
        asked = spark.createDataFrame(sorted({(r.doc_id, r.hash) for r in marks}), "doc_id long, hash long")
        fetched = self.rows.join(F.broadcast(asked), ["doc_id", "hash"]).select("doc_id", "hash", "text", "meta").dropDuplicates(["doc_id", "hash"]).toPandas()  # one row a mark
        features = {(i, h): (_unsigned(a), _unsigned(b)) for i, h, a, b in fetched.itertuples(index=False)}
        out: list[list[Mark]] = [[], []]
        for r in sorted(marks, key=lambda r: (r.v, not r.label, r.rank)):
            out[r.v].append((r.doc_id, r.label, features[r.doc_id, r.hash]))
        return out


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.int32).view(np.uint32)


def co_train(views: tuple[list[np.ndarray], list[np.ndarray]], y: np.ndarray, pool: tuple[list[np.ndarray], list[np.ndarray]] | Distributed, held: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE, most: int = FEATURES) -> Scorer:
    """Fits both views on the rows that aren't held, with marks exchanged over the pool; calibrates on the held rows."""
    source = Listed(pool) if isinstance(pool, tuple) else pool
    train = np.flatnonzero(~held)
    given: list[dict[int, tuple[bool, np.ndarray]]] = [{}, {}]  # marks that a view got from the other
    fitted: list[View] = []
    part = float(y[train].mean())
    wanted = {label: int(np.ceil(share * p * source.size)) for label, p in ((True, part), (False, 1 - part))}
    for turn in range(rounds + 1):
        fitted = [_fit([rows[i] for i in train] + [x for _, x in given[v].values()], np.r_[y[train], np.array([label for label, _ in given[v].values()], bool)], most) for v, rows in enumerate(views)]
        if turn == rounds:
            break
        for v, marks in enumerate(source.best(fitted, [set(given[1]), set(given[0])], wanted, sure)):
            for i, label, features in marks:
                given[1 - v].setdefault(i, (label, features[1 - v]))
    order = np.flatnonzero(held)[np.argsort(y[held], kind="stable")]  # either half has its share of both classes
    for view, rows in zip(fitted, views, strict=True):
        view.slope, view.intercept = fit_platt(view.raw([rows[i] for i in order[::2]]), y[order[::2]])
    rest = order[1::2] if len(order) > 3 else order
    return Scorer(*fitted, combination(np.column_stack([view.odds([rows[i] for i in rest]) for view, rows in zip(fitted, views, strict=True)]), y[rest]))


def combination(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the views' log-odds and the intercept; a view whose weight would be negative is left out."""
    weights = fit_logistic(odds, y, penalty=1e-2, rounds=400)
    if (weights[:-1] < 0).any():
        use = weights[:-1] > 0 if (weights[:-1] > 0).any() else np.array([True, False])
        alone = fit_logistic(odds[:, use], y, penalty=1e-2, rounds=400)
        weights = np.zeros(odds.shape[1] + 1)
        weights[:-1][use], weights[-1] = np.maximum(alone[:-1], 0), alone[-1]
    return weights


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        text = [text_features(t.as_py()) for t in batch.column("text")]
        meta = [meta_features(*m) for m in zip(*(batch.column(c).to_pylist() for c in META), strict=True)]
        hashes = [int(a.sum(dtype=np.uint64)) + int(b.sum(dtype=np.uint64)) for a, b in zip(text, meta, strict=True)]
        lists = (pa.array([x.view(np.int32) for x in rows], pa.list_(pa.int32())) for rows in (text, meta))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes, pa.int64()), *lists], ["doc_id", "hash", "text", "meta"])


def view_table(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, hash (of the features) and the features of both views. Sorted hashes are stored by their differences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    rows = source.mapInArrow(_hashed, f"doc_id {kind}, hash long, text array<int>, meta array<int>")
    return written(rows, "views", **{"parquet.writer.version": "v2", "parquet.enable.dictionary#text.list.element": "false"})


def train(table: DataFrame, labels: DataFrame, most: int = MOST, pool: int = POOL) -> Scorer | None:
    """The scorer, or None if the labels don't hold both classes among the fitted and among the held rows."""
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null")
    chosen = hash_sample(chosen.join(table.select("doc_id"), "doc_id", "left_semi"), "doc_id", most)
    rows = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.struct("hash", "text", "meta")).alias("_b"))
    # Of several rows with a doc_id that of the largest hash stands: one row each, `most` at most.
    sample = rows.select("doc_id", "quality", "_b.text", "_b.meta").toPandas().sort_values("doc_id")
    good = sample["quality"].to_numpy() > 0
    held = (H.mix(sample["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(4)) == 0
    if any(len(np.unique(good[part])) < 2 for part in (held, ~held)):
        return None
    views = tuple([_unsigned(x) for x in sample[c]] for c in ("text", "meta"))
    return co_train(views, good, Distributed(table, labels, pool), held)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MOST, pool: int = POOL) -> DataFrame:
    """Per row of docs: doc_id, p_text, p_meta, quality (the combined probability) and keeps: quality >= threshold.

    Null and empty texts are scored by their looks, null metadata is a value of its own. If the labels don't hold
    both classes, every score is 0.5 and all documents are kept. Equal rows get equal scores. Other columns are
    left out; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    table = view_table(docs)
    scorer = docs.sparkSession.sparkContext.broadcast(train(table, labels, most, pool))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer.value
        for batch in parts(batches):
            text, meta, both = np.full((3, batch.num_rows), 0.5)
            if model:
                text, meta, both = model.score_columns(batch.column("text"), batch.column("meta"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (text, meta, both, both >= threshold))], ["doc_id", "p_text", "p_meta", "quality", "keeps"])

    return table.select("doc_id", "text", "meta").mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, quality double, keeps boolean")
