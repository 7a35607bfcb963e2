"""Tracks of what detectors see in the frames of a file, in batch and on a stream.

An observation has a time, a box, a vector and a score. Moment by moment, open tracks are met first by the overlap of boxes (the likeness of vectors
must not speak against it), then by the likeness of vectors alone, always the best pair first; what is left over opens a track. A track
that nothing has met for longer than a gap is closed and goes out.

On a stream observations may be out of order as far as the watermark allows: they wait until the watermark has passed them. Timers in event time
wake a file for what waits and for what is due to close, so that a track closes although nothing more comes of its file, and a file whose tracks
are all closed leaves no state. The result is that of the batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds until a track closes, least overlap, least likeness with and without overlap, observations that a track keeps.
GAP, OVERLAP, TRACKABLE, ALIKE, BEST = 1.2, 0.3, 0.35, 0.55, 8
#: Rows of a file that are worked on together, if its stretches are shorter.
STRETCH = 5000
OUT = "file string, first timestamp, last timestamp, n long, best timestamp, box array<double>, vector array<double>, first_box array<double>, last_box array<double>"
KEPT = "first double, last double, n long, first_box array<double>, last_box array<double>, scores array<double>, times array<double>, boxes array<double>, vectors array<double>"
WAITING = "ts double, id long, box array<double>, vector array<double>, score double"
Seen = tuple[float, int, np.ndarray, np.ndarray, float]


@dataclass
class Track:
    """first and last time, number of observations, first and last box; of the best observations scores, times, boxes and unit vectors in order of arrival."""

    first: float
    last: float
    n: int
    first_box: np.ndarray
    last_box: np.ndarray
    top: list[tuple[float, float, np.ndarray, np.ndarray]] = field(default_factory=list)

    def extend(self, ts: float, box: np.ndarray, vector: np.ndarray, score: float, best: int) -> None:
        self.last, self.n, self.last_box = ts, self.n + 1, box
        if len(self.top) == best:
            least = min(range(best), key=lambda i: self.top[i][0])
            if score <= self.top[least][0]:
                return
            del self.top[least]
        self.top.append((score, ts, box, vector))

    def anchor(self) -> np.ndarray:
        return np.mean([t[3] for t in self.top], axis=0)

    def row(self) -> tuple:
        scores = np.array([t[0] for t in self.top])
        vectors = np.stack([t[3] for t in self.top])
        mean = (vectors * scores[:, None]).sum(axis=0) if scores.sum() > 0 else vectors.sum(axis=0)
        best = self.top[int(scores.argmax())]
        return (_stamp(self.first), _stamp(self.last), self.n, _stamp(best[1]), best[2].tolist(), (mean / max(np.linalg.norm(mean), 1e-12)).tolist(), self.first_box.tolist(), self.last_box.tolist())

    def state(self) -> tuple:
        flat = lambda k: np.concatenate([t[k] for t in self.top]).tolist()
        return (self.first, self.last, self.n, self.first_box.tolist(), self.last_box.tolist(), [t[0] for t in self.top], [t[1] for t in self.top], flat(2), flat(3))

    @classmethod
    def of(cls, first, last, n, first_box, last_box, scores, times, boxes, vectors) -> Track:
        cut = lambda x: np.asarray(x, float).reshape(len(scores), -1)
        return cls(first, last, n, np.asarray(first_box, float), np.asarray(last_box, float), list(zip(scores, times, cut(boxes), cut(vectors), strict=True)))


def _stamp(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b."""
    side = lambda i, j: np.maximum(0, np.minimum(a[:, None, j], b[None, :, j]) - np.maximum(a[:, None, i], b[None, :, i]))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    common = side(0, 2) * side(1, 3)
    union = area(a)[:, None] + area(b)[None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def matched(worth: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of allowed pairs, each once at most, the worthiest first; of equal ones the later row, then the later column."""
    rows, columns = np.nonzero(may)
    out, taken_rows, taken_columns = [], set(), set()
    for k in np.lexsort((-columns, -rows, -worth[rows, columns])):
        i, j = int(rows[k]), int(columns[k])
        if i not in taken_rows and j not in taken_columns:
            taken_rows.add(i)
            taken_columns.add(j)
            out.append((i, j))
    return out


def advance(tracks: list[Track], seen: list[Seen], gap: float = GAP, best: int = BEST) -> list[Track]:
    """Closed tracks, after observations in order of time have extended or joined the open ones in `tracks`."""
    closed = []
    moments: dict[float, list[Seen]] = {}
    for x in sorted(seen, key=lambda x: (x[0], x[1])):
        moments.setdefault(x[0], []).append(x)
    for ts, now in moments.items():
        closed += [t for t in tracks if ts - t.last > gap]
        tracks[:] = [t for t in tracks if ts - t.last <= gap]
        pairs: list[tuple[int, int]] = []
        if tracks:
            anchors = np.stack([t.anchor() for t in tracks])
            alike = (anchors / np.maximum(np.linalg.norm(anchors, axis=1, keepdims=True), 1e-12)) @ np.stack([x[3] for x in now]).T
            share = overlaps(np.stack([t.last_box for t in tracks]), np.stack([x[2] for x in now]))
            pairs = matched(share, (share >= OVERLAP) & (alike >= TRACKABLE))
            rest = alike >= ALIKE
            rest[[i for i, _ in pairs]] = False
            rest[:, [j for _, j in pairs]] = False
            pairs += matched(alike, rest)
        for i, j in pairs:
            tracks[i].extend(ts, *now[j][2:], best)
        met = {j for _, j in pairs}
        for j, (_, _, box, vector, score) in enumerate(now):
            if j not in met:
                tracks.append(Track(ts, ts, 0, box, box))
                tracks[-1].extend(ts, box, vector, score, best)
    return closed


def observations(g: pd.DataFrame) -> list[Seen]:
    """Rows (ts, id, box, vector, score) as observations; a row that lacks one, or has a zero vector, is none."""
    out = []
    for r in g.itertuples(index=False):
        if pd.isna(r.ts) or pd.isna(r.id) or r.box is None or r.vector is None:
            continue
        v = np.asarray(r.vector, float)
        size = np.linalg.norm(v)
        if np.isfinite(size) and size > 1e-10:
            out.append((r.ts if isinstance(r.ts, float) else r.ts.value / 1e9, int(r.id), np.asarray(r.box, float), v / size, 0.0 if pd.isna(r.score) else float(r.score)))
    return out


def _table(file: str | None, tracks: list[Track]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame([(file, *t.row()) for t in tracks], columns=names)


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("file").cast("string").alias("file"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col("box").cast("array<double>").alias("box"), F.col("vector").cast("array<double>").alias("vector"), F.col("score").cast("double").alias("score"))


def batch_tracks(df: DataFrame, gap: float = GAP) -> DataFrame:
    """Tracks (columns of OUT) of observations (file, ts, id, box, vector, score).

    A file is cut where nothing is seen for longer than the gap, which closes all its tracks; short stretches go together, some `STRETCH` rows at a time. So
    only an unbroken stretch has to be one task's work. Observations without time, id, box or vector are left out; a null file is a file.
    """
    rows = _columns(df).where("ts IS NOT NULL AND id IS NOT NULL AND box IS NOT NULL AND vector IS NOT NULL")
    by_time = Window.partitionBy("file").orderBy("ts", "id")
    seconds = F.unix_micros("ts") / 1e6
    begins = F.coalesce(seconds - F.lag(seconds).over(by_time) > gap, F.lit(True))
    rows = rows.withColumn("_first", F.when(begins, F.row_number().over(by_time)))
    rows = rows.withColumn("_part", F.floor(F.last("_first", ignorenulls=True).over(by_time) / STRETCH))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracks: list[Track] = []
        closed = advance(tracks, observations(g), gap)
        return _table(g["file"].iloc[0], closed + tracks)

    return rows.groupBy("file", "_part").applyInPandas(run, OUT)


class _Tracker(StatefulProcessor):
    def __init__(self, gap: float) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", KEPT)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [x for g in rows for x in observations(g)]
        if new:
            self.waiting.appendList([(ts, i, box.tolist(), vector.tolist(), score) for ts, i, box, vector, score in new])
            self.handle.registerTimer(math.ceil(min(x[0] for x in new) * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000  # nothing up to here is still to come
        waiting = [(ts, i, np.asarray(box), np.asarray(v), score) for ts, i, box, v, score in self.waiting.get()]
        tracks = [Track.of(*t) for t in self.open.get()]
        closed = advance(tracks, [x for x in waiting if x[0] <= passed], self.gap)
        closed += [t for t in tracks if passed - t.last >= self.gap]
        tracks = [t for t in tracks if passed - t.last < self.gap]
        later = [x for x in waiting if x[0] > passed]
        for state, rows in ((self.open, [t.state() for t in tracks]), (self.waiting, [(ts, i, box.tolist(), v.tolist(), score) for ts, i, box, v, score in later])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        due = [x[0] for x in later] + [t.last + self.gap for t in tracks]
        if due:
            self.handle.registerTimer(math.ceil(min(due) * 1000))
        if closed:
            yield _table(key[0], closed)

    def close(self) -> None:
        pass


def stream_tracks(df: DataFrame, late: str = "10 seconds", gap: float = GAP) -> DataFrame:
    """batch_tracks on a stream, in append mode. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).

    An observation later than `late` behind the latest time seen in any file is dropped.
    """
    return _columns(df).withWatermark("ts", late).groupBy("file").transformWithStateInPandas(_Tracker(gap), OUT, "append", "EventTime")
