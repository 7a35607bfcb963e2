"""Blur, crops and portraits against plain versions; a stage that stops half way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as X
from tessera.operators import snapshots


def plain_blur(image):
    """The definition, pixel by pixel, with borders reflected."""
    h, w = image.shape
    mirror = lambda i, n: min(abs(i) % (2 * n - 2), 2 * n - 2 - abs(i) % (2 * n - 2))
    values = []
    for axis in (0, 1):
        at = lambda y, x, d: image[mirror(y + d, h), x] if axis == 0 else image[y, mirror(x + d, w)]  # noqa: B023, E731
        soft = np.array([[np.mean([at(y, x, d) for d in range(-4, 5)]) for x in range(w)] for y in range(h)])
        own, left = (np.abs(np.diff(v, axis=axis))[1:-1, 1:-1] for v in (image, soft))
        if own.sum() <= 1e-6:
            return 1.0
        values.append(float((own.sum() - np.maximum(0, own - left).sum()) / own.sum()))
    return max(values)


def test_blur_equals_the_definition():
    rng = np.random.default_rng(1)
    for h, w in ((4, 4), (5, 9), (16, 12), (30, 7)):
        image = rng.integers(0, 256, (h, w)).astype(float)
        assert X.crete_roffet(image) == pytest.approx(plain_blur(image))
    sharp = np.kron(rng.integers(0, 2, (10, 10)) * 255.0, np.ones((2, 2)))
    soft = np.array([[np.mean(sharp[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4]) for x in range(20)] for y in range(20)])
    assert X.crete_roffet(soft) > X.crete_roffet(sharp)
    assert X.crete_roffet(np.full((8, 8), 3.0)) == 1.0 and X.crete_roffet(np.ones((3, 9))) is None


def test_blur_in_spark(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (6, 5)).astype(float)
    rows = [(1, image.ravel().tolist(), 5, 6), (2, None, 5, 6), (3, [1.0, 2.0], 5, 6), (4, image.ravel().tolist(), None, 6), (5, [0.0] * 9, 3, 3)]
    got = {r.k: r.b for r in spark.createDataFrame(rows, "k int, p array<double>, w int, h int").select("k", X.blur(F.col("p"), F.col("w"), F.col("h")).alias("b")).collect()}
    assert got == {1: pytest.approx(plain_blur(image)), 2: None, 3: None, 4: None, 5: None}


def test_squares_lie_in_the_picture(spark):
    rows = [([10.0, 10.0, 30.0, 20.0], 100, 80), ([0.0, 0.0, 10.0, 10.0], 100, 80), ([90.0, 70.0, 100.0, 80.0], 100, 80), ([0.0, 0.0, 100.0, 10.0], 100, 80), (None, 9, 9)]
    got = [r.s for r in spark.createDataFrame(rows, "box array<double>, w int, h int").select(X.square(F.col("box"), F.col("w"), F.col("h"), 2.0).alias("s")).collect()]
    assert got[0] == [0, 0, 40, 40] and got[1] == [0, 0, 20, 20] and got[2] == [80, 60, 100, 80] and got[3] == [10, 0, 90, 80]
    for s, (_, w, h) in zip(got[:4], rows, strict=False):
        assert 0 <= s[0] < s[2] <= w and 0 <= s[1] < s[3] <= h and s[2] - s[0] == s[3] - s[1]


def test_portraits(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None, i, None if i % 7 == 0 else float(rng.integers(0, 5)) / 5, [None, 0.0, 20.0, 90.0, 400.0][int(rng.integers(0, 5))], None if i % 11 == 0 else float(rng.integers(0, 6)) / 5) for i in range(120)]
    got = {r.g: (r.face, r.score) for r in X.portraits(spark.createDataFrame(rows, "g string, face long, blur double, size double, confidence double"), "g", 20).collect()}
    for g in ("hot", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[4] is None, -(r[4] or 0), r[1]))[:20]
        score = lambda r: (1 - (0.5 if r[2] is None else r[2])) * (0.4 + 0.6 * min(r[3] or 60.0, 160.0) / 160) * (0.5 + 0.5 * (r[4] or 0))
        best = max(own, key=score)
        assert got[g] == (best[1], pytest.approx(score(best)))


def test_a_stage_goes_on_after_a_stop(spark, tmp_path):
    catalog = snapshots.Catalog(spark, str(tmp_path))
    schema = "id long, v long, version long"
    wanted = spark.range(1000).select("id", (F.col("id") * 3).alias("v"), F.lit(1).cast("long").alias("version"))
    computed, calls = [], []

    def double(todo, fail_at=None):
        calls.append(1)
        if fail_at is not None and len(calls) > fail_at:
            raise RuntimeError("stopped")
        computed.append(todo.count())
        return todo.withColumn("v", F.col("v") * 2)

    run = lambda wanted, fail_at=None: snapshots.stage_in_parts(catalog, "t", schema, "id", ["version"], wanted, lambda todo: double(todo, fail_at), 100)
    with pytest.raises(RuntimeError):
        run(wanted, 4)
    assert catalog.version("t") == 0 and len(computed) == 4 and 300 < sum(computed) < 500
    first = sum(computed)
    assert run(wanted) == 1000 - first and sum(computed) == 1000  # nothing is computed twice
    assert sorted((r.id, r.v) for r in catalog.read("t", schema).collect()) == [(i, 6 * i) for i in range(1000)]
    assert run(wanted) == 0 and catalog.version("t") == 1 and not (tmp_path / "t" / "_pending").exists()
    changed = wanted.withColumn("version", F.when(F.col("id") < 50, 2).otherwise(1).cast("long")).withColumn("v", F.when(F.col("id") < 50, 1).otherwise(F.col("v")).cast("long"))
    calls.clear()
    with pytest.raises(RuntimeError):
        run(changed, 0)
    assert run(changed) == 50 and {r.v for r in catalog.read("t", schema).where("id < 50").collect()} == {2}
