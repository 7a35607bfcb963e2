"""Scores: ramps, weighted parts, calibration, decision ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ramp(x: Column, start: float, stop: float) -> Column:
    """0 at start, 1 at stop, linear between; null stays null."""
    return clamp((x - start) / (stop - start))


def logistic(x: Column, centre: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / scale))


def known_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known; null without any."""
    total = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts))
    return F.when(weight > 0, total / weight)


def complement_product(weights: Column, share: float = 0.85) -> Column:
    """1 - product(1 - share * weight): many entries approach 1."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda p, w: p * (1 - share * w))


def target_size(count: Column, factor: float, low: int, high: int) -> Column:
    """factor * sqrt(count), rounded half to even, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(factor * F.sqrt(count.cast("double"))).cast("int")))


def rejections(*rules: tuple[Column, str]) -> Column:
    """Names of all rules that hold."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules)))


def first_of(*rules: tuple[Column, str], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for rule, name in rules[1:]:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def moving_average(values: Column, keep: float = 0.6) -> Column:
    """old * keep + new * (1 - keep) over an ordered array; the first value starts it."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)).cast("double"), lambda old, new: old * keep + new * (1 - keep))


def exposure_text(seconds: Column) -> Column:
    """1/N below a second, else seconds."""
    return F.when(seconds <= 0, F.lit(None)).when(seconds < 1, F.concat(F.lit("1/"), F.bround(1 / seconds).cast("int").cast("string"), F.lit(" s"))).otherwise(F.concat(F.format_string("%.1f", seconds), F.lit(" s")))


def content_rating(safe: Column, explicit_tag: Column, questionable: Column, explicit: Column, nudity: Column, suggestive: Column, threshold: float = 0.55) -> Column:
    """Rating by two opinions, a region detector's and a tagger's: a lone signal must be strong and unopposed."""
    calm = (safe >= 0.9) & (F.greatest(explicit_tag, questionable) < 0.25)
    leads = lambda x: (x >= F.greatest(safe, explicit_tag, questionable)) & (x > safe)
    support = (explicit_tag >= 0.35) | (questionable >= 0.35) | leads(explicit_tag) | leads(questionable)
    strong, weak = max(threshold, 0.62), min(threshold, 0.45)
    seen = lambda x: ((x >= strong) & ~calm) | ((x >= weak) & support)
    return first_of(
        (seen(explicit) | ((explicit_tag >= 0.75) & leads(explicit_tag)), "explicit"),
        (seen(nudity) | ((explicit_tag >= 0.6) & (leads(explicit_tag) | leads(questionable))), "nudity"),
        (((suggestive >= 0.6) & support) | ((questionable >= 0.65) & leads(questionable)), "suggestive"),
        otherwise="safe",
    )
