"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring. A row's key hashes to a place; the
next point clockwise names its home shard. A shard never holds more than its capacity:
of an overloaded shard's arcs the last keys of each arc go on clockwise to the next
shard that has room. Rows whose home has room never move, so that movement is limited to
the overflow.

Only one count per arc (shards * vnodes numbers, whatever the input) reaches the driver;
the plan that goes back is a table of rank ranges of the same order of size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Parts in which each arc's rows are ranked.
STRANDS = 32


def ring_points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places on the ring (signed 64 bits) and the shard that owns each."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big", signed=True), shard)
        for shard in range(shards)
        for node in range(vnodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(total: int, shards: int, epsilon: float) -> np.ndarray:
    """Rows that each shard may hold: (1 + epsilon) times the mean; at 0 they add up to total exactly."""
    if epsilon <= 0:
        return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    return np.full(shards, int(np.ceil((1 + epsilon) * total / shards)), np.int64)


def plan_ring(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the keys of each arc go.

    An overloaded shard keeps the same share of each of its arcs; the rest of an arc walks
    clockwise. Each range takes the shard's next free slots, so slots have no gaps.
    """
    load = np.bincount(owner, weights=counts, minlength=len(capacity)).astype(np.int64)
    keep = counts.copy()
    for shard in np.flatnonzero(load > capacity):
        arcs = np.flatnonzero(owner == shard)
        share = [int(x) * int(capacity[shard]) // int(load[shard]) for x in np.cumsum(counts[arcs])]
        keep[arcs] = np.diff([0, *share])
    used = np.zeros(len(capacity), np.int64)
    plan = []

    def put(arc: int, start: int, end: int, shard: int) -> None:
        if end > start:
            plan.append((arc, start, end, int(shard), int(used[shard])))
            used[shard] += end - start

    for arc, shard in enumerate(owner):
        put(arc, 0, int(keep[arc]), shard)
    for arc in np.flatnonzero(counts > keep):
        at, end, to = int(keep[arc]), int(counts[arc]), int(arc)
        while at < end:
            to = (to + 1) % len(owner)
            n = int(min(end - at, capacity[owner[to]] - used[owner[to]]))
            put(int(arc), at, at + n, owner[to])
            at += max(n, 0)
    return plan


def shard_rows(df: DataFrame, key: str, carry: list[str], shards: int = 8, vnodes: int = 512, epsilon: float = 0.0) -> DataFrame:
    """Rows of (key, *carry) with shard and slot (0 to the shard's rows - 1, without gaps).

    Keys may be null or repeat: a row without a key is placed by its carried columns, equal rows are
    counted once with their number before anything is shuffled by arc, and get one slot each. The
    order in an arc is by strand, place on the ring, key and the carried columns, so the
    result depends on the rows alone. Columns of df other than key and carry are left out. An
    empty table gives an empty one.
    """
    spark = df.sparkSession
    points, owner = ring_points(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, place.to_numpy(np.int64)) % len(points), dtype="int32")

    columns = [key, *carry]
    rows = df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    place = F.when(F.col(key).isNull(), F.xxhash64(*columns)).otherwise(F.xxhash64(key))
    rows = written(rows.withColumn("_place", place).withColumn("_arc", arc_of("_place")).withColumn("_strand", F.pmod(F.xxhash64(*columns), F.lit(STRANDS)).cast("int")), "ring")
    counts = np.zeros(len(points), np.int64)
    for arc, n in rows.groupBy("_arc").agg(F.sum("_copies")).collect():  # shards * vnodes rows at most
        counts[arc] = n
    plan = plan_ring(counts, owner, capacities(int(counts.sum()), shards, epsilon))
    plan = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "_arc int, _from long, _to long, shard int, _slot long")

    # A key with very many rows falls on one arc: an arc is ranked in strands, by a hash of the whole row, and counted through.
    before = Window.partitionBy("_arc").orderBy("_strand").rowsBetween(Window.unboundedPreceding, -1)  # STRANDS rows
    starts = rows.groupBy("_arc", "_strand").agg(F.sum("_copies").alias("_n")).select("_arc", "_strand", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("_arc", "_strand").orderBy("_place", *columns).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_in", F.sum("_copies").over(order)).join(F.broadcast(starts), ["_arc", "_strand"])  # shards * vnodes * STRANDS rows at most
    ranked = ranked.withColumn("_end", F.col("_first") + F.col("_in")).withColumn("_start", F.col("_end") - F.col("_copies"))
    first, last = F.greatest("_start", "_from"), F.least("_end", "_to") - 1
    placed = ranked.join(F.broadcast(plan), "_arc").where(first <= last)  # the plan's size is bounded by the ring's
    placed = placed.withColumn("_rank", F.explode(F.sequence(first, last)))
    return placed.select(*columns, "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = 512) -> DataFrame:
    """All documents to shards whose row counts differ by one at most (law `rows`).

    size is the text's UTF-8 bytes plus 1 (null text: 1), text_crc32 its checksum (null: as empty).
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard_rows(sized, "doc_id", ["size", "text_crc32"], shards, vnodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
