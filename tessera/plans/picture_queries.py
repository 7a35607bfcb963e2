"""Sharpness, crops and portraits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as X
from .registry import Tables, query


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, l_linenumber * 3.0 AS y1, CAST(l_quantity AS DOUBLE) + 20 AS x2, l_linenumber * 3.0 + l_suppkey % 40 + 5 AS y2 FROM lineitem),
s AS (SELECT *, least(greatest(x2 - x1, y2 - y1) * 1.6, 100.0, 80.0) AS side FROM b),
p AS (SELECT *, least(greatest((x1 + x2) / 2 - side / 2, 0.0), 100 - side) AS x, least(greatest((y1 + y2) / 2 - side / 2, 0.0), 80 - side) AS y FROM s)
SELECT l_orderkey, l_linenumber, CAST(floor(x) AS BIGINT) AS a, CAST(floor(y) AS BIGINT) AS b, CAST(round_even(x + side, 0) AS BIGINT) AS c, CAST(round_even(y + side, 0) AS BIGINT) AS d FROM p""")
def face_squares(t: Tables) -> DataFrame:
    """Square crops around boxes, moved inside the picture."""
    low = F.col("l_linenumber") * 3.0
    box = F.array(F.col("l_quantity").cast("double"), low, F.col("l_quantity").cast("double") + 20, low + F.col("l_suppkey") % 40 + 5)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", X.square(box, F.lit(100), F.lit(80)).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", *(F.col("s")[i].alias(c) for i, c in enumerate("abcd")))


@query("""
WITH f AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS face, l_discount * 10 AS blur, l_quantity * 4 AS size, l_tax * 10 AS confidence FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY confidence DESC NULLS LAST, face) AS rank FROM f),
s AS (SELECT *, (1 - coalesce(blur, 0.5)) * (0.4 + 0.6 * (least(coalesce(nullif(size, 0), 60.0), 160.0) / 160.0)) * (0.5 + 0.5 * coalesce(confidence, 0.0)) AS score FROM r WHERE rank <= 30)
SELECT l_suppkey, face, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, rank) = 1""")
def group_portraits(t: Tables) -> DataFrame:
    """The best picture of each group among its surest members."""
    faces = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face"), (F.col("l_discount") * 10).alias("blur"), (F.col("l_quantity") * 4).alias("size"), (F.col("l_tax") * 10).alias("confidence"))
    return X.portraits(faces, "l_suppkey").select("l_suppkey", "face", F.round("score", 9).alias("score"))


@query()
def image_blur(t: Tables) -> DataFrame:
    """Blur of pictures of eight by eight pixels."""
    pixels = F.transform("embedding", lambda x: F.round(x.cast("double") * 255, 3))
    return t("embeddings").select("vec_id", F.round(X.blur(pixels, F.lit(8), F.lit(8)), 6).alias("blur"))
