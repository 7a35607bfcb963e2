"""Scores of files from vectors and measured parts: preferred vectors, aesthetic and curation scores, themes, label heads."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vectors as V

#: What stands for an unknown visual score, weights of identities, ratings and types that may pass.
VISUAL_PRIOR, IDENTITY_WEIGHT = 0.25, {"person": 1.0, "cluster": 0.6, "noise": 0.2}
SAFE_RATINGS, OVERRIDABLE_TYPES = ("safe", "unknown"), ("game", "graphics", "meme")
#: How far a file must stand out in a theme, and in what must not be in it.
THEME = {"theme_z": 2.6, "theme_margin": 0.018, "theme_min_pool": 60, "negative_z": 1.5}
#: Median by an order of ranks this fine.
ACCURACY = 1_000_000


def preferred_vectors(vectors: DataFrame, calibrated: list[str], preferred: str, prompted: list[str]) -> DataFrame:
    """(path, model, vector): one of each file's vectors (path, model, vector). Calibrated models with prompts first, among them the
    preferred one, then the preferred one at all, then one with prompts, then any; the smaller name of equal ones."""
    good = [m for m in calibrated if m in prompted]
    model = F.col("model")
    order = F.when((model == preferred) & model.isin(good), 0).when(model.isin(good), 1).when(model == preferred, 2).when(model.isin(prompted), 3).otherwise(4)
    best = vectors.groupBy("path").agg(F.min_by(F.struct("model", "vector"), F.struct(order.alias("o"), "model")).alias("b"))
    return best.select("path", "b.model", "b.vector")


def aesthetic_raw(vector: Column, prompts: list[tuple[float, list[float]]]) -> Column:
    """Weighted mean similarity with prompts of positive weight less that with those of negative weight. Both are linear in the
    vector, hence one product with the prompts' difference."""
    side = lambda sign: [(abs(w), np.asarray(p, float)) for w, p in prompts if w * sign > 0]
    mean = lambda found: sum(w * p for w, p in found) / max(sum(w for w, _ in found), 1e-9) if found else 0.0
    against = mean(side(1)) - mean(side(-1)) + np.zeros(len(prompts[0][1]))
    return V.dot(V.unit(vector), F.array(*(F.lit(float(x)) for x in against)))


def technical_parts(c: dict[str, Column]) -> dict[str, Column]:
    """Sharpness, resolution, exposure, contrast and compression from 0 to 1; null where what they need isn't known."""
    pixels = F.coalesce(c["width"], F.lit(0)) * F.coalesce(c["height"], F.lit(0)) / 1e6
    exposure = (1 - S.ramp(F.abs(c["brightness"] - 0.45), 0.15, 0.45)) * (1 - 0.7 * S.ramp(F.coalesce(c["clipped"], F.lit(0.0)), 0.05, 0.35))
    return {
        "sharpness": S.ramp(F.log10(F.when(c["blur"].isNotNull(), F.greatest(c["blur"], F.lit(1e-3)))), float(np.log10(25)), float(np.log10(600))),
        "resolution": F.when(pixels > 0, S.ramp(F.log2(pixels / 0.2), 0.0, float(np.log2(4 / 0.2)))).otherwise(0.0),
        "exposure": exposure,
        "contrast": S.ramp(c["contrast"], 0.05, 0.20),
        "compression": F.when(pixels > 0, S.ramp(c["size"] / F.greatest(pixels * 1e6, F.lit(1.0)), 0.03, 0.15)).otherwise(0.0),
    }


def face_weights(faces: Column, width: Column, height: Column) -> Column:
    """array<struct(person, prominence, weight)> of the faces (person, label, hidden, left, top, right, bottom) that count."""
    area = (width * height).cast("double")

    def entry(f: Column) -> Column:
        ratio = F.when(area > 0, F.sqrt(F.greatest(F.lit(0.0), (f["right"] - f["left"]) * (f["bottom"] - f["top"])) / area)).otherwise(0.0)
        kind = F.when(f["person"].isNotNull(), IDENTITY_WEIGHT["person"]).when(f["label"] >= 0, IDENTITY_WEIGHT["cluster"]).otherwise(IDENTITY_WEIGHT["noise"])
        prominence = F.coalesce(S.ramp(ratio, 0.03, 0.20), F.lit(0.0))
        return F.struct(f["person"].alias("person"), F.round(prominence, 3).alias("prominence"), F.round(prominence * kind, 3).alias("weight"))

    return F.transform(F.filter(faces, lambda f: ~F.coalesce(f["hidden"], F.lit(False))), entry)


def curation_scores(df: DataFrame, key: list[str], c: dict[str, Column]) -> DataFrame:
    """(key, technical, visual, base, personal, face_count, known_people, eligible, rejections, details) of every row.

    c names the inputs: width, height, size, blur, brightness, clipped, contrast, raw, centre, scale (of the visual score), faces,
    reliable (whether the content type can be trusted), type, camera, rating, taken. A null input is not known.
    """
    parts = technical_parts(c)
    weights = dict(zip(parts, (0.40, 0.20, 0.20, 0.10, 0.10), strict=True))
    technical = F.coalesce(S.known_mean([(parts[p], w) for p, w in weights.items()]), F.lit(0.0))
    visual = S.logistic(c["raw"], c["centre"], c["scale"])
    low, high = F.least(c["width"], c["height"]), F.greatest(c["width"], c["height"])
    camera = F.coalesce(c["camera"], F.lit("")) != ""
    kind, trusted = F.coalesce(c["type"], F.lit("unknown")), F.coalesce(c["reliable"], F.lit(False))
    missing = F.coalesce(c["width"], F.lit(0)) * F.coalesce(c["height"], F.lit(0)) == 0
    rules = [
        (trusted & (kind != "photo") & ~(camera & kind.isin(*OVERRIDABLE_TYPES)), F.concat(F.lit("content:"), kind)),
        (~trusted & ~camera, F.lit("content:unverified")),
        (c["rating"].isNotNull() & ~c["rating"].isin(*SAFE_RATINGS), F.concat(F.lit("adult:"), c["rating"])),
        (missing | (low < 480) | (c["width"] * c["height"] / 1e6 < 0.2), F.lit("too_small")),
        (c["blur"] < 15, F.lit("blurry")),
        (~missing & (high / F.greatest(low, F.lit(1)) > 4), F.lit("odd_aspect")),
        (~c["brightness"].between(0.05, 0.96), F.lit("exposure")),
        (c["taken"].isNull(), F.lit("no_time")),
    ]
    rejected = F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))
    rows = df.select(*key, technical.alias("technical"), visual.alias("visual"), face_weights(c["faces"], c["width"], c["height"]).alias("_faces"), rejected.alias("rejections"), F.struct(*(x.alias(p) for p, x in parts.items())).alias("details"))
    seen = F.filter("_faces", lambda f: f["prominence"] > 0)
    return rows.select(
        *key, "technical", "visual", (0.55 * F.coalesce("visual", F.lit(VISUAL_PRIOR)) + 0.45 * F.col("technical")).alias("base"),
        S.complement_product(F.transform("_faces", lambda f: f["weight"])).alias("personal"), F.size(seen).alias("face_count"),
        F.size(F.array_distinct(F.array_compact(F.transform(seen, lambda f: f["person"])))).alias("known_people"),
        (F.size("rejections") == 0).alias("eligible"), "rejections", "details",
    )


def _matrices(df: DataFrame, keep: list[str], vector: str, name: str, make) -> DataFrame:
    """keep and an array of doubles that `make` gives for each batch of vectors, a matrix."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for start in range(0, len(g), 1024):
                part = g.iloc[start : start + 1024]
                out = part[keep].copy()
                out[name] = list(make(part, np.stack(part[vector].to_list()).astype(np.float64)))
                yield out

    return df.select(*keep, vector).mapInPandas(run, f"{schema}, {name} array<double>")


def themes(items: DataFrame, prompts: dict[str, dict[str, list[list[float]]]], p: dict = THEME) -> DataFrame:
    """(key, theme, z) of the items (key, model, vector) that stand out in a theme.

    prompts: descriptions of themes by model and theme (a fixed list: it is broadcast); themes that begin with `not-` spoil an item. An
    item's similarity with a theme is that with its likest description; it counts by how many deviations it lies above the
    mean of all items of the model, and by how far above their median (of an even number, the mean of both middle ones). Models with too few items give no theme.
    """
    spark = items.sparkSession
    known = items.where(F.col("vector").isNotNull() & F.col("model").isin(*prompts))
    stacked = spark.sparkContext.broadcast({m: [(t, np.asarray(v, float)) for t, v in sorted(by.items())] for m, by in prompts.items()})

    def sims(part: pd.DataFrame, matrix: np.ndarray) -> list[np.ndarray]:
        unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-12)[:, None]
        return [np.array([(v @ x).max() for _, v in stacked.value[m]]) for m, x in zip(part["model"], unit, strict=True)]

    rows = _matrices(known, ["key", "model"], "vector", "sims", sims)
    spread = rows.select("model", F.posexplode("sims").alias("pos", "sim"))
    facts = spread.groupBy("model", "pos").agg(F.avg("sim").alias("mean"), F.greatest(F.stddev_pop("sim"), F.lit(1e-6)).alias("std"), ((F.percentile_approx("sim", 0.5, ACCURACY) - F.percentile_approx(-F.col("sim"), 0.5, ACCURACY)) / 2).alias("median"), F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(m, i, t) for m, by in prompts.items() for i, t in enumerate(sorted(by))], "model string, pos int, theme string")
    facts = facts.where(F.col("n") >= p["theme_min_pool"]).join(F.broadcast(names), ["model", "pos"])  # one row a theme and model
    each = rows.select("key", "model", F.posexplode("sims").alias("pos", "sim")).join(F.broadcast(facts), ["model", "pos"])
    z, spoils = (F.col("sim") - F.col("mean")) / F.col("std"), F.col("theme").startswith("not-")
    best = each.groupBy("key").agg(
        F.bool_or(spoils & (z >= p["negative_z"])).alias("_spoiled"),
        F.max(F.when(~spoils, F.struct(z.alias("z"), (-F.col("pos")).alias("first"), "theme", (F.col("sim") - F.col("median")).alias("above")))).alias("b"),
    )
    return best.where(~F.col("_spoiled") & (F.col("b.z") >= p["theme_z"]) & (F.col("b.above") >= p["theme_margin"])).select("key", "b.theme", "b.z")


def zero_shot(items: DataFrame, labels: dict[str, list[float]], sharpness: float = 20.0) -> DataFrame:
    """(key, label, confidence) of the likeliest label by a softmax over the labels' prompt vectors; ties to the first."""
    names, bank = list(labels), items.sparkSession.sparkContext.broadcast(np.array(list(labels.values()), float))

    def chances(part: pd.DataFrame, matrix: np.ndarray) -> np.ndarray:
        z = matrix @ bank.value.T * sharpness
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    rows = _matrices(items.where("vector is not null"), ["key"], "vector", "p", chances)
    at = F.array_position("p", F.array_max("p")).cast("int")
    return rows.select("key", F.element_at(F.array(*map(F.lit, names)), at).alias("label"), F.array_max("p").alias("confidence"))


def head_scores(items: DataFrame, labels: list[str], layers: list[tuple[np.ndarray, np.ndarray]], version: str) -> DataFrame:
    """(key, label, score, version): a trained head's sigmoid scores of all labels, on unit vectors, by batches of 1,024.

    layers: (weights, bias) of one linear layer, or of two with a GELU between them.
    """
    shared = items.sparkSession.sparkContext.broadcast(layers)

    def scored(part: pd.DataFrame, matrix: np.ndarray) -> np.ndarray:
        x = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        *inner, (w, b) = shared.value
        erf = np.frompyfunc(math.erf, 1, 1)
        for v, c in inner:
            x = x @ v + c
            x = 0.5 * x * (1 + erf(x / math.sqrt(2)).astype(float))
        return 1 / (1 + np.exp(-(x @ w + b)))

    rows = _matrices(items.where("vector is not null"), ["key"], "vector", "scores", scored)
    return rows.select("key", F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("label"), F.col("scores").alias("score"))).alias("s")).select("key", "s.label", "s.score", F.lit(version).alias("version"))


def laplacian_variance(pixels: Column, width: int, height: int) -> Column:
    """Variance of a grey image's Laplacian, inside its border: low where it is blurred. pixels: row by row."""
    at = lambda y, x: F.get(pixels, F.lit(y * width + x))
    edge = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(1, height - 1) for x in range(1, width - 1)]
    values = F.array(*(e.cast("double") for e in edge))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / len(edge)
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v) / len(edge) - mean * mean


def sharpness_weight(blur: Column) -> Column:
    """How much a frame's sharpness (0 sharp, 1 blurred) lifts it when a track's best frames are chosen; unknown: 1."""
    return F.coalesce(S.clamp((0.95 - blur) / 0.35, 0.15, 1.0), F.lit(1.0))
