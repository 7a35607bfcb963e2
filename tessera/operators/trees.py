"""Roll-ups over folders and album trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .snapshots import written


def folder_counts(df: DataFrame, path: str, size: str) -> DataFrame:
    """(folder, files, subtree, bytes): files directly in each folder, and all below it with their bytes.

    Files are counted by folder before the folders' ancestors are spread out, so that the
    shuffle holds folders and not files.
    """
    direct = df.groupBy(P.parent(F.col(path)).alias("own")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    spread = direct.select("own", "n", "bytes", F.explode(P.chain(F.col("own"))).alias("folder"))
    return spread.groupBy("folder").agg(F.sum(F.when(F.col("own") == F.col("folder"), F.col("n")).otherwise(0)).alias("files"), F.sum("n").alias("subtree"), F.sum("bytes").alias("bytes"))


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of a forest (id, parent), each node with itself.

    One level at a time, written, until a level adds nothing: however deep the trees are. Where parents form a cycle, each of its nodes is
    above every node below it, at the least distance.
    """
    rows = nodes.select("id", "parent")
    parents = written(rows.where("parent is not null").select(F.col("id").alias("ancestor"), "parent"))
    known = written(rows.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct())
    step, d = known, 0
    while True:
        d += 1
        step = step.join(parents, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("distance")).distinct()
        step = written(step.join(known, ["id", "ancestor"], "left_anti"))
        if step.isEmpty():
            return known
        known = known.union(step)


def tree_totals(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, depth, own, total) of a forest; members (id) are counted with repetition."""
    counts = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    up = closure(nodes)
    total = up.join(counts, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("total"))
    depth = up.groupBy("id").agg(F.max("distance").alias("depth"))
    rows = nodes.select("id").join(depth, "id").join(counts, "id", "left").join(total, "id", "left")
    return rows.select("id", "depth", F.coalesce("n", F.lit(0)).alias("own"), F.coalesce("total", F.lit(0)).alias("total"))


def inherited(nodes: DataFrame, flag: str) -> DataFrame:
    """(id, flag): set if a node's own or an ancestor's is."""
    flags = nodes.select(F.col("id").alias("ancestor"), F.col(flag).cast("boolean").alias("_flag"))
    return closure(nodes).join(flags, "ancestor").groupBy("id").agg(F.bool_or("_flag").alias(flag))


def trails(nodes: DataFrame) -> DataFrame:
    """(id, trail): titles from the top down, joined by slashes."""
    titles = nodes.select(F.col("id").alias("ancestor"), "title")
    rows = closure(nodes).join(titles, "ancestor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "title"))).alias("t"))  # one title a level
    return rows.select("id", F.array_join("t.title", " / ").alias("trail"))


def may_move(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, target, allowed) of moves (id, target): no node goes below itself."""
    below = closure(nodes).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.lit(True).alias("_below"))
    return moves.join(below, ["id", "target"], "left").select("id", "target", F.col("_below").isNull().alias("allowed"))
