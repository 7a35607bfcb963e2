"""Small logistic models on hashed text features, fitted on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts
from .store import hash_sample

#: Lengths in bytes of the word beginnings that are features next to whole words.
PREFIXES = (4, 5, 6, 7)


def text_features(text: str | None) -> np.ndarray:
    """Distinct hashes of the lower-case words (runs of letters), of their beginnings and of what the text looks like."""
    raw = (text or "").encode()
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    starts, ends = H.bounds(data, H.NOT_LETTER)
    sums = H.prefix_sums(data)
    found = [H.spans(sums, starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        found.append(H.mix(H.spans(sums, starts[longer], starts[longer] + n) + np.uint64(n)))
    found.append(H.mix(np.array(looks(raw, found[0]), np.uint64)))
    return short(np.concatenate(found))


def short(hashes: np.ndarray) -> np.ndarray:
    """Distinct features: the upper halves of hashes, which is what the driver holds of a sample."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def looks(raw: bytes, words: np.ndarray) -> list[int]:
    """Numbered coarse classes of a text: length, shares of distinct words, capitals, signs and digits, the commonest word's share."""
    n, size = len(words), max(1, len(raw))
    data = np.frombuffer(raw, np.uint8)
    share = lambda k: int(np.ceil(10 * min(1.0, k)))
    counts = np.unique(words, return_counts=True)[1] if n else np.zeros(1)
    same = int((words[1:] == words[:-1]).sum()) if n else 0
    facts = (
        int(np.log2(size)),
        share(len(counts) / max(1, n)),
        share(counts.max() / max(1, n)),
        share(((data >= 65) & (data <= 90)).sum() / size),
        share(5 * ((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)).sum() / size),
        share(5 * ((data >= 48) & (data <= 57)).sum() / size),
        share(same / max(1, n)),
    )
    return [(i + 1) * 1000 + x for i, x in enumerate(facts)]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights and, last, the intercept: penalised likelihood by accelerated gradient steps. x: (rows, features)."""
    ones = np.ones((len(x), 1), np.float32)
    x, y = np.hstack((x.astype(np.float32, copy=False), ones)), y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # largest curvature; a step that is too long would never settle
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * 1.05 * float(np.linalg.norm(x.T @ (x @ v))) + penalty + 1e-6)
    shrink = np.full(len(w), penalty, np.float32)
    shrink[-1] = 0
    for _ in range(rounds):
        slope = x.T @ (sigmoid(x @ ahead) - y) + shrink * ahead
        after, t2 = ahead - step * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + np.float32((t - 1) / t2) * (after - w)
        w, t = after, t2
    return w.astype(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities."""
    scale = float(np.std(z)) or 1.0
    w = fit_logistic((z / scale)[:, None], y, penalty=1e-2, rounds=400)
    return float(w[0]) / scale, float(w[1])


def pick_features(rows: list[np.ndarray], y: np.ndarray, most: int, least_rows: int = 3) -> np.ndarray:
    """The `most` features whose presence tells the classes apart best (G statistic), sorted."""
    count = lambda part: np.unique(np.concatenate(part) if part else np.empty(0, np.uint32), return_counts=True)
    keys, seen = count(rows)
    own, times = count([r for r, good in zip(rows, y.astype(bool), strict=True) if good])
    n, pos = len(rows), float(y.sum())
    seen, both = seen.astype(float), np.zeros(len(keys))
    both[np.searchsorted(keys, own)] = times
    a, b = both + 0.5, seen - both + 0.5
    c, d = pos - both + 0.5, n - pos - seen + both + 0.5
    g = a * np.log(a * (n + 2) / ((a + b) * (a + c))) + b * np.log(b * (n + 2) / ((a + b) * (b + d))) + c * np.log(c * (n + 2) / ((c + d) * (a + c))) + d * np.log(d * (n + 2) / ((c + d) * (b + d)))
    g[seen < least_rows] = -1
    best = np.lexsort((keys, -g))[:most]
    return np.sort(keys[best[g[best] > 0]])


def matrix(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """Presence of the features, one row a text."""
    out = np.zeros((len(rows), len(features)), np.float32)
    if len(features):
        for i, found in enumerate(rows):
            at = np.minimum(np.searchsorted(features, found), len(features) - 1)
            out[i, at[features[at] == found]] = 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, extra: list[str] = []) -> pd.DataFrame:  # noqa: B006
    """At most `most` labelled documents, by a hash of doc_id: doc_id, label columns, extra columns and `features`.

    Labels of one doc_id are combined by their largest; of several rows with it the text of the largest hash stands.
    """
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    chosen = chosen.where(" and ".join(f"{c} is not null" for c in columns))
    chosen = hash_sample(chosen.join(docs.select("doc_id"), "doc_id", "left_semi"), "doc_id", most)
    # One row a doc_id, `most` at most: where several share it, the text of the largest hash, found on numbers alone.
    every = docs.select("doc_id", F.xxhash64("text").alias("_version"), "text", *extra).join(F.broadcast(chosen), "doc_id")
    kept = every.groupBy("doc_id").agg(F.max("_version").alias("_version"))
    rows = every.join(F.broadcast(kept), ["doc_id", "_version"]).drop("_version")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [text_features(t.as_py()).view(np.int32) for t in batch.column("text")]
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found, pa.list_(pa.int32()))], [*own, "features"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "text")
    found = rows.mapInArrow(hashed, f"{kinds}, features array<int>")
    out = found.dropDuplicates(["doc_id"]).toPandas()  # rows equal in doc_id and text
    out["features"] = [np.asarray(x, np.int32).view(np.uint32) for x in out["features"]]
    return out.sort_values("doc_id").reset_index(drop=True)
