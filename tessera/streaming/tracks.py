"""Continuously arriving observations: sessions, calendar windows, running means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "5 hours", late: str = "1 day") -> DataFrame:
    """(key, start, stop, n) of sessions that a pause longer than gap ends; batch or stream alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("stop"))
    return out.select(key, F.col("w.start").alias("start"), "stop", "n")


def buckets(events: DataFrame, ts: str, width: str, *by: Column, late: str = "1 day") -> DataFrame:
    """(start, *by, n) of tumbling windows."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.col("w.start")).drop("w")


def running_means(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, mean, n): component means that new rows (key, vector) go on updating."""
    rows = df.select(key, F.posexplode("vector").alias("pos", "x"))
    return rows.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
