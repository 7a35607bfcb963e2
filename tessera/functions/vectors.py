"""Vectors, boxes, intervals and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it has none or holds what isn't finite. Vector and length are bound to variables, or each component would
    compute them again."""
    finite = lambda u: F.forall(u, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    divided = lambda u, n: F.when(finite(u) & (n > 1e-12), F.transform(u, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(v), lambda u: F.get(F.transform(F.array(norm(u)), lambda n: divided(u, n)), F.lit(0))), F.lit(0))


def sign_hash(v: Column, bits: int = 63) -> Column:
    """One bit per component from the sign of the step to the next."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda h, i: h * 2 + (F.get(v, i) > F.get(v, i + 1)).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [left, top, right, bottom]."""
    side = lambda i, j: F.greatest(F.lit(0.0), F.least(a[j], b[j]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    common = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def overlap_seconds(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end1, end2) - F.greatest(start1, start2))


def near_in_time(start1: Column, end1: Column, start2: Column, end2: Column, gap: float) -> Column:
    """Whether two ranges overlap or lie at most gap apart."""
    return (start1 <= end2 + gap) & (start2 <= end1 + gap)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)
