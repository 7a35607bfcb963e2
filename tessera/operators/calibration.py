"""Thresholds of stitching from named tracks: a grid, files held out whole, and no error allowed.

Files with named tracks are put in the order of a hash of their name; every third is held out. Each file's tracks are stitched and attached under each
threshold, without regard to the names, and then judged by them. All thresholds of a file are tried where its tracks lie, whose likenesses
are computed once; what goes on is a few numbers a file and threshold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import identities as I
from .clusters import stitched
from .curation import guard
from .near import units
from .tables import ranked

#: The thresholds that are tried, and by how much attaching by several pairs and by one pair is stricter.
GRID = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
STRICTER, SINGLE = (0.07, 0.98), (0.13, 0.99)


def judged(label: np.ndarray, person: list) -> tuple[int, int, int, int]:
    """(wrong, covered, excess, unresolved): named tracks in an identity that mostly is somebody else's; named tracks in any; identities beyond one a
    person; tracks in none."""
    names, pieces = defaultdict(Counter), defaultdict(set)
    for g, who in zip(label, person, strict=True):
        if g >= 0 and who is not None:
            names[g][who] += 1
            pieces[who].add(g)
    covered = sum(sum(c.values()) for c in names.values())
    return covered - sum(max(c.values()) for c in names.values()), covered, sum(len(x) - 1 for x in pieces.values()), int((label < 0).sum())


def trials(df: DataFrame, file: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(file, threshold, wrong, covered, excess, unresolved) of samples (file, track, ts, quality, core, vector, person)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        guard(g)
        g = g.sort_values(["track", "ts", "quality"], ascending=[True, True, False])
        tracks = [rows for _, rows in g.groupby("track")]
        banks = []
        for rows in tracks:
            quality, v = rows["quality"].fillna(0).to_numpy(float), units(rows["vector"])
            banks.append(v[I.varied(quality, v)])
        core = np.array([bool(rows["core"].fillna(False).astype(bool).any()) for rows in tracks])
        person = [None if rows["person"].isna().all() else rows["person"].dropna().min() for rows in tracks]
        moments = [set(rows["ts"].dropna()) for rows in tracks]
        cannot = np.array([[i != j and bool(a & b) for j, b in enumerate(moments)] for i, a in enumerate(moments)])
        at = np.flatnonzero(core)
        apart = {(i, j) for i in range(len(at)) for j in range(i) if cannot[at[i], at[j]]}
        out = []
        for threshold in grid:
            label = np.full(len(tracks), -1)
            if len(at):
                label[at] = stitched([banks[i] for i in at], apart, threshold)
            label = I.attached(banks, label, cannot, *(min(most, threshold + more) for more, most in (STRICTER, SINGLE)))
            out.append((g[file].iloc[0], threshold, *judged(label, person)))
        return pd.DataFrame(out, columns=[file, "threshold", "wrong", "covered", "excess", "unresolved"])

    rows = df.select(file, "track", "ts", "quality", "core", "vector", "person").where(f"`{file}` IS NOT NULL AND track IS NOT NULL AND vector IS NOT NULL")
    return rows.groupBy(file).applyInPandas(run, f"{file} {dict(df.dtypes)[file]}, threshold double, wrong long, covered long, excess long, unresolved long")


def calibrated(df: DataFrame, file: str, checkpoint: Callable[[DataFrame], DataFrame], grid: tuple[float, ...] = GRID) -> DataFrame:
    """(threshold, wrong, covered, excess, unresolved, the same of the held-out files as test_..., chosen): one row a threshold.

    Chosen is, of the thresholds without a wrong track in the files that aren't held out, the one that covers most tracks; ties go to fewer pieces, then to the
    higher threshold. None is chosen if all err or cover nothing. Without a named track there is no row.
    """
    named = df.where("person IS NOT NULL AND track IS NOT NULL AND vector IS NOT NULL").select(F.col(file).alias("_file")).where("_file IS NOT NULL").distinct()
    place = ranked(named.withColumn("_hash", F.concat(F.sha2(F.col("_file").cast("string"), 256), F.lit(" "), F.col("_file").cast("string"))), "_hash", "_rank").select("_file", (F.pmod(F.col("_rank") - 1, F.lit(3)) == 0).alias("test"))
    place = checkpoint(place)
    each = checkpoint(trials(df.join(place.select(F.col("_file").alias(file)), file), file, grid)).join(place.withColumnRenamed("_file", file), file)
    facts = ("wrong", "covered", "excess", "unresolved")
    sums = [F.sum(F.when(held == F.col("test"), F.col(c)).otherwise(0)).alias(prefix + c) for held, prefix in ((F.lit(False), ""), (F.lit(True), "test_")) for c in facts]
    rows = each.groupBy("threshold").agg(*sums)
    order = Window.orderBy(F.desc("_safe"), F.desc("covered"), "excess", F.desc("threshold"))  # a row a threshold
    rows = rows.withColumn("_safe", (F.col("wrong") == 0) & (F.col("covered") > 0))
    return rows.withColumn("chosen", F.col("_safe") & (F.row_number().over(order) == 1)).drop("_safe")
