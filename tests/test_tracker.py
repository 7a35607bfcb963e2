"""Tracks in batch and on a stream against a plain version; links to earlier tracks against a walk in order."""

import datetime
import itertools

import numpy as np
import pytest

from tessera.operators import matching
from tessera.operators.snapshots import written
from tessera.streaming import tracker as T

SCHEMA = "file string, ts timestamp, id long, box array<double>, vector array<double>, score double"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=float(seconds))


def scene(rng, file, length, people=3, first_id=0):
    """People who move slowly, vanish at times and are sometimes not seen."""
    faces = np.linalg.qr(rng.normal(size=(8, 8)))[0][:people]
    where, rows = rng.uniform(0, 300, (people, 2)), []
    for k in range(length):
        where += rng.normal(size=(people, 2)) * 4
        for p in range(people):
            if rng.random() < 0.75 and (k // 12 + p) % 4:
                box = [*where[p], *(where[p] + 50)]
                rows.append((file, at(0.5 * k), first_id + len(rows), [float(x) for x in box], (faces[p] * 2 + 0.2 * rng.normal(size=8)).tolist(), float(rng.integers(1, 5)) / 4))
    return rows


def iou(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def plain(rows, gap=T.GAP):
    """One file's tracks as (first, last, n), by lists and loops."""
    closed, open_ = [], []
    for ts in sorted({r[1] for r in rows}):
        now = [(r[3], np.array(r[4]) / np.linalg.norm(r[4]), r[5]) for r in sorted(rows, key=lambda r: r[2]) if r[1] == ts]
        closed += [t for t in open_ if (ts - t["last"]).total_seconds() > gap]
        open_ = [t for t in open_ if (ts - t["last"]).total_seconds() <= gap]
        cos = lambda t, d: float(np.mean([v for _, v in t["top"]], axis=0) @ d[1] / np.linalg.norm(np.mean([v for _, v in t["top"]], axis=0)))
        pairs = sorted(((iou(t["box"], d[0]), i, j) for i, t in enumerate(open_) for j, d in enumerate(now)), reverse=True)
        likes = sorted(((cos(t, d), i, j) for i, t in enumerate(open_) for j, d in enumerate(now)), reverse=True)
        cosine, mine, theirs, met = {(i, j): c for c, i, j in likes}, set(), set(), []
        for value, i, j in [p for p in pairs if p[0] >= T.OVERLAP and cosine[p[1:]] >= T.TRACKABLE] + [p for p in likes if p[0] >= T.ALIKE]:
            if i not in mine and j not in theirs:
                mine.add(i)
                theirs.add(j)
                met.append((i, j))
        for i, j in met:
            t, (box, v, score) = open_[i], now[j]
            t["last"], t["n"], t["box"] = ts, t["n"] + 1, box
            t["top"].append((score, v))
            if len(t["top"]) > T.BEST:
                low = min(range(T.BEST), key=lambda k: t["top"][k][0])
                del t["top"][T.BEST if score <= t["top"][low][0] else low]
        open_ += [{"first": ts, "last": ts, "n": 1, "box": d[0], "top": [(d[2], d[1])]} for j, d in enumerate(now) if j not in theirs]
    return sorted((t["first"], t["last"], t["n"]) for t in closed + open_)


def test_batch_equals_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [*scene(rng, "a", 80), *scene(rng, "b", 40, 5), *scene(rng, None, 10)]
    late = [(f, t + datetime.timedelta(seconds=100), *rest) for f, t, *rest in scene(rng, "a", 20, first_id=9000)]
    bad = [("a", at(1), None, [0.0, 0.0, 1.0, 1.0], [1.0] * 8, 1.0), ("a", None, 5, [0.0, 0.0, 1.0, 1.0], [1.0] * 8, 1.0), ("a", at(1), 7000, None, [1.0] * 8, 1.0), ("a", at(1), 7001, [0.0, 0.0, 1.0, 1.0], [0.0] * 8, None)]
    got = {}
    for r in T.batch_tracks(spark.createDataFrame([*rows, *late, *bad], SCHEMA).repartition(4)).collect():
        got.setdefault(r.file, []).append((r.first, r.last, r.n))
        assert np.linalg.norm(r.vector) == pytest.approx(1) and r.first <= r.best <= r.last
    for f in ("a", "b", None):
        assert sorted(got[f]) == plain([r for r in [*rows, *late] if r[0] == f])
    assert len(got["a"]) > 6 and T.batch_tracks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overlap_goes_before_likeness():
    a, b = np.array([1.0, 0]), np.array([0.6, 0.8])
    box, far = np.array([0.0, 0, 10, 10]), np.array([90.0, 90, 99, 99])
    open_ = []
    assert T.advance(open_, [(0.0, 1, box, a, 1.0)]) == [] and len(open_) == 1
    T.advance(open_, [(0.5, 2, far, a, 1.0), (0.5, 3, box + 1, b, 1.0)])  # the one in place is met, though the other looks more alike
    assert sorted(t.n for t in open_) == [1, 2] and open_[0].last_box.tolist() == (box + 1).tolist()
    closed = T.advance(open_, [(5.0, 4, box, a, 1.0)])
    assert len(closed) == 2 and len(open_) == 1
    against = np.array([-1.0, 0])
    T.advance(open_, [(5.5, 5, box, against, 1.0)])
    assert len(open_) == 2  # in place, but another face


def test_stream_equals_batch_and_leaves_no_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    rows = [*scene(rng, "a", 60), *scene(rng, "b", 50), *scene(rng, "silent", 8)]  # the last has no further row after 4 seconds
    rows.sort(key=lambda r: (r[1].timestamp() + rng.uniform(0, 5)))  # out of order by up to 5 seconds
    wanted = sorted((r.file, r.first, r.last, r.n, r.best, tuple(r.last_box)) for r in T.batch_tracks(spark.createDataFrame(rows, SCHEMA)).collect())
    end = [("end", at(10_000 + k), 1, [0.0, 0.0, 1.0, 1.0], [1.0] * 8, 1.0) for k in (0, 10_000)]
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for i, part in enumerate([*(rows[a:b] for a, b in itertools.pairwise(cuts)), end[:1], end[1:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = T.stream_tracks(stream, "10 seconds").writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.file, r.first, r.last, r.n, r.best, tuple(r.last_box)) for r in spark.table("timed").collect() if r.file != "end")
    assert got == wanted and len(wanted) > 8
    for name in ("open", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).select("key.file").distinct().collect()
        assert {r.file for r in left} <= {"end"}


def test_earlier_tracks_equal_a_walk_in_order(spark):
    rng = np.random.default_rng(9)
    faces = np.linalg.qr(rng.normal(size=(6, 6)))[0]

    def make(n, first):
        rows = []
        for i in range(n):
            start = float(rng.integers(0, 40)) + (590.0 if i % 5 == 0 else 0.0)
            rows.append((["f", "g"][i % 2], first + i, start, start + float(rng.integers(0, 6)), (faces[int(rng.integers(0, 4))] + 0.25 * rng.normal(size=6)).tolist()))
        return rows

    new, old = make(60, 0), make(50, 1000)
    extra = [("f", 500, None, 1.0, new[0][4]), ("f", 501, 1.0, 2.0, None), (None, 502, 1.0, 2.0, new[0][4])]
    schema = "file string, id long, start double, stop double, vector array<double>"
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    taken, wanted, unsure = set(), {}, 0
    for file, i, start, stop, v in sorted(new, key=lambda r: (r[2], r[1])):
        free = sorted(((-float(unit(v) @ unit(o[4])), o[1]) for o in old if o[0] == file and (file, o[1]) not in taken and start <= o[3] + 0.75 and o[2] <= stop + 0.75 and unit(v) @ unit(o[4]) >= 0.5))
        if free and (len(free) == 1 or free[1][0] - free[0][0] >= 0.08):
            taken.add((file, free[0][1]))
            wanted[file, i] = free[0][1]
        unsure += len(free) > 1 and (file, i) not in wanted
    got = {(r.file, r.id): r.old_id for r in matching.earlier_tracks(spark.createDataFrame([*new, *extra], schema), spark.createDataFrame(old, schema), written).collect()}
    assert got == wanted and len(wanted) > 10 and unsure > 1
    assert matching.earlier_tracks(spark.createDataFrame([], schema), spark.createDataFrame(old, schema), written).collect() == []
