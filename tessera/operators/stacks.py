"""Stacks of alike faces: what a viewer shows as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import matching as M
from .snapshots import written

#: Bits of copies anywhere, bits of a series in one folder, and its seconds and cosine.
COPY_BITS, SERIES_BITS, SERIES_SECONDS, SERIES_SIMILARITY = 4, 10, 3.0, 0.6


def _stars(rows: DataFrame, *keys: str) -> DataFrame:
    """(a, b): every row to the least id of its keys."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.select(F.col("id").alias("b"), *keys).join(first, list(keys)).where("a < b").select("a", "b")


def face_stacks(faces: DataFrame, bits: int = 64) -> DataFrame:
    """(id, top): the stack's face that lies on top, for every face.

    faces: id, path, kind, folder, taken (seconds), dhash (its low `bits` bits), vector (unit length), blur, place (order of display).
    Faces of one video are one stack; so are photos whose hashes nearly agree, those of one folder whose hashes agree
    loosely, and those of one folder within a few seconds whose faces are alike. Unknown values are like nothing. On top lies
    the sharpest (unknown: 1), of equal ones the first in order.
    """
    rows = written(faces.withColumn("folder", F.coalesce("folder", F.lit(""))))
    video = F.coalesce(F.col("kind") == "video", F.lit(False))
    photos = rows.where(~video)
    hashed = photos.where("dhash is not null")
    slot = F.floor(F.col("taken") / SERIES_SECONDS)
    timed = photos.where("taken is not null and vector is not null").select("id", "folder", "taken", "vector", slot.alias("slot"))
    other = timed.select(F.col("id").alias("b"), "folder", F.col("taken").alias("_taken"), F.col("vector").alias("_vector"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    moments = timed.withColumnRenamed("id", "a").join(other, ["folder", "slot"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("taken") - F.col("_taken")) <= SERIES_SECONDS))
    moments = moments.where(V.dot(F.col("vector"), F.col("_vector")) >= SERIES_SIMILARITY).select("a", "b")
    edges = _stars(rows.where(video), "path").union(_stars(hashed, "dhash")).union(moments)
    edges = edges.union(M.hash_pairs(hashed, "id", "dhash", COPY_BITS, bits).select("a", "b"))
    edges = edges.union(M.hash_pairs(hashed, "id", "dhash", SERIES_BITS, bits, within="folder").select("a", "b"))
    roots = M.components(edges, written)
    placed = rows.select("id", "blur", "place").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    tops = placed.groupBy("root").agg(F.min_by("id", F.struct(F.coalesce("blur", F.lit(1.0)).alias("b"), "place")).alias("top"))
    return placed.join(tops, "root").select("id", "top")
