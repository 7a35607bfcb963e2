"""Sharpness and crops of pictures whose pixels are an array of brightness, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places that the blur test smooths over; what a portrait's size is held against, and takes the place of an unknown one.
TAPS, FULL, UNKNOWN = 9, 160.0, 60.0


def crete_roffet(image: np.ndarray) -> float | None:
    """0 sharp to 1 blurred: how little of the differences between neighbours a strong smoothing takes away, along the worse axis.

    A picture without any difference is blurred; one of fewer than four rows or columns has no value.
    """
    image = np.asarray(image, np.float64)
    if image.ndim != 2 or min(image.shape) < 4:
        return None
    worst = 0.0
    for turned in (image, image.T):
        around = np.pad(turned, ((TAPS // 2, TAPS // 2), (0, 0)), "reflect") if len(turned) > TAPS // 2 else turned[_mirrored(len(turned))]
        sums = np.vstack((np.zeros(turned.shape[1]), np.cumsum(around, axis=0)))
        smooth = (sums[TAPS:] - sums[:-TAPS]) / TAPS
        own, left = (np.abs(np.diff(x, axis=0))[1:-1, 1:-1] for x in (turned, smooth))
        if own.sum() <= 1e-6:
            return 1.0
        worst = max(worst, 1 - np.maximum(0, own - left).sum() / own.sum())
    return float(worst)


def _mirrored(n: int) -> np.ndarray:
    """Places of n rows continued by reflection on either side, however short they are."""
    at = np.abs(np.arange(-(TAPS // 2), n + TAPS // 2)) % (2 * n - 2)
    return np.minimum(at, 2 * n - 2 - at)


def blur(pixels: Column, width: Column, height: Column) -> Column:
    """crete_roffet of each picture; null where the pixels don't fill width x height."""

    @F.pandas_udf("double")
    def scored(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(p: np.ndarray | None, w: float, h: float) -> float | None:
            if p is None or pd.isna(w) or pd.isna(h) or w <= 0 or len(p) != w * h:
                return None
            return crete_roffet(np.asarray(p, float).reshape(int(h), int(w)))

        return pd.Series([one(*x) for x in zip(pixels, width, height, strict=True)], dtype="float64")

    return scored(pixels, width, height)


def square(box: Column, width: Column, height: Column, scale: float = 1.6) -> Column:
    """The square [left, top, right, bottom] around a box, `scale` times its longer side, moved inside the picture and no larger than it."""
    side = F.least(F.greatest(box[2] - box[0], box[3] - box[1]) * scale, width.cast("double"), height.cast("double"))
    start = lambda low, high, most: F.least(F.greatest((low + high) / 2 - side / 2, F.lit(0.0)), most - side)
    x, y = start(box[0], box[2], width), start(box[1], box[3], height)
    return F.array(F.floor(x), F.floor(y), F.bround(x + side).cast("long"), F.bround(y + side).cast("long"))


def portrait_score(blur: Column, size: Column, confidence: Column) -> Column:
    """How well a face would do as the picture of its group: sharp, large, surely one of it."""
    large = F.least(F.coalesce(F.nullif(size, F.lit(0)), F.lit(UNKNOWN)), F.lit(FULL)) / FULL
    return (1 - F.coalesce(blur, F.lit(0.5))) * (0.4 + 0.6 * large) * (0.5 + 0.5 * F.coalesce(confidence, F.lit(0.0)))


def portraits(faces: DataFrame, group: str, most: int = 30) -> DataFrame:
    """(group, face, score) of faces (group, face, blur, size, confidence): the best portrait among the `most` surest of each group.

    Ties go to the surer face, then to the smaller number. `most` is the feature's own limit; each task sends that many a group.
    """
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("confidence"), "face")
    some = faces.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).withColumn("score", portrait_score(F.col("blur"), F.col("size"), F.col("confidence")))
    best = some.groupBy(group).agg(F.max(F.struct("score", (-F.col("_rank")).alias("r"), "face")).alias("_b"))
    return best.select(group, "_b.face", "_b.score")
