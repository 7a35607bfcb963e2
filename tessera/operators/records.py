"""Small upkeep of records: order, flags, exclusions, reviews, moves, settings, workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from . import matching as M
from .snapshots import written
from .trees import closure


def first_seen(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, value, at): each value once, where it comes first."""
    return df.groupBy(*group, value).agg(F.min(order).alias("at"))


def dirty(changes: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """(key, reason) of what changed (key, at, reason) after it was last built (key, at), or was never built; the latest change tells why."""
    last = changes.groupBy(key).agg(F.max(F.struct("at", "reason")).alias("c"))
    done = built.groupBy(key).agg(F.max("at").alias("_built"))
    return last.join(done, key, "left").where(F.col("_built").isNull() | (F.col("c.at") > F.col("_built"))).select(key, "c.reason")


def excluded(files: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """files (path, state) after exclusions (path: a file or a folder) were set and others lifted; a set one wins."""
    chain = F.array_union(F.array(F.col("path")), P.chain(P.parent(F.col("path"))))
    spots = files.select("path", F.explode(chain).alias("_at"))
    met = lambda rows, name: spots.join(rows.select(F.col("path").alias("_at")).distinct(), "_at").select("path").distinct().withColumn(name, F.lit(True))
    rows = files.join(met(add, "_add"), "path", "left").join(met(remove, "_lift"), "path", "left")
    state = F.when(F.col("_add"), "excluded").when(F.col("_lift") & (F.col("state") == "excluded"), "known").otherwise(F.col("state"))
    return rows.select("path", state.alias("state"))


def root_totals(files: DataFrame, roots: list[str]) -> DataFrame:
    """(root, files, excluded) of the files (path, state) inside each root (a few: a list)."""
    rows = files.select("state", F.explode(F.filter(F.array(*(F.when(P.inside(F.col("path"), r), F.lit(r)) for r in roots)), lambda x: x.isNotNull())).alias("root"))
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "excluded").alias("excluded"))


def propagated_reviews(items: DataFrame, reviewed: DataFrame, least: float = 0.985) -> DataFrame:
    """(key, label, source) of items (key, vector) that are nearly a reviewed one (key, label): the likest one's label, ties to its smaller key."""
    bank = items.join(reviewed, "key").select(F.lit(0).alias("person"), F.col("key").alias("sample"), F.col("vector").alias("p"))
    queries = items.join(reviewed.select("key"), "key", "left_anti").select(F.col("key").alias("q"), F.col("vector").alias("v"))
    near = M.bank_scores(queries, bank, best=1).groupBy("q").agg(F.max(F.struct("sim", (-F.col("sample")).alias("m"))).alias("b")).where(F.col("b.sim") >= least)
    return near.select(F.col("q").alias("key"), (-F.col("b.m")).alias("source")).join(reviewed.select(F.col("key").alias("source"), "label"), "source").select("key", "label", "source")


def track_pairs(tracks: DataFrame) -> DataFrame:
    """(file, a, b, sim, truth) of all pairs of one file's tracks (file, track, person, vector); truth is unknown where a person is."""
    other = tracks.select("file", F.col("track").alias("b"), F.col("person").alias("_p"), F.col("vector").alias("_v"))
    pairs = tracks.withColumnRenamed("track", "a").join(other, "file").where("a < b")
    truth = F.when(F.col("person").isNull() | F.col("_p").isNull(), "unknown").when(F.col("person") == F.col("_p"), "same").otherwise("different")
    return pairs.select("file", "a", "b", F.round(V.dot(F.col("vector"), F.col("_v")), 6).alias("sim"), truth.alias("truth"))


def merged_speakers(clusters: DataFrame, least: float) -> DataFrame:
    """(id, speaker, seconds, vector) of voice clusters (id, file, seconds, vector): those of one file that are alike, or linked by alike
    ones, are one speaker (the least id), whose unit vector is their mean weighted by seconds."""
    other = clusters.select("file", F.col("id").alias("b"), F.col("vector").alias("_v"))
    edges = clusters.withColumnRenamed("id", "a").join(other, "file").where((F.col("a") < F.col("b")) & (V.dot(F.col("vector"), F.col("_v")) >= least)).select("a", "b")
    roots = M.components(edges, written).withColumnRenamed("node", "id")
    rows = clusters.join(roots, "id", "left").withColumn("speaker", F.coalesce("root", "id"))
    sums = rows.select("speaker", "seconds", F.posexplode("vector").alias("pos", "x")).groupBy("speaker", "pos").agg(F.sum(F.col("x") * F.col("seconds")).alias("s"), F.sum("seconds").alias("n"))
    mean = sums.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("v"), F.max("n").alias("seconds"))
    return rows.select("id", "speaker").join(mean, "speaker").select("id", "speaker", "seconds", V.unit(F.col("v")).alias("vector"))


def assigned_speaker(prints: DataFrame, given: DataFrame) -> DataFrame:
    """Voice prints (person, vector, n) after manual assignments (person, vector): the running mean of unit vectors; a new person starts one."""
    new = given.select("person", F.posexplode(V.unit(F.col("vector"))).alias("pos", "x"), F.lit(1).alias("n"))
    old = prints.select("person", F.posexplode("vector").alias("pos", "x"), "n").select("person", "pos", (F.col("x") * F.col("n")).alias("x"), "n")
    sums = old.union(new.select("person", "pos", "x", "n")).groupBy("person", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = sums.groupBy("person").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"), F.max("n").cast("long").alias("n"))
    return rows.select("person", V.unit(F.col("v")).alias("vector"), "n")


def planned_moves(files: DataFrame, folders: list[str], target: str) -> DataFrame:
    """(path, to, conflict) of the files (path) below the folders (a few) when these are moved into target. A folder inside another one
    moves with it; a place that a file has already, or that two files would get, is a conflict."""
    outer = [f for f in sorted(set(folders)) if not any(f != g and f.startswith(g.rstrip("/") + "/") for g in folders)]
    to = F.lit(None).cast("string")
    for f in outer:
        to = F.when(P.inside(F.col("path"), f), F.concat(F.lit(target.rstrip("/") + "/" + f.rstrip("/").rsplit("/", 1)[-1]), F.expr(f"substring(path, {len(f.rstrip('/')) + 1})"))).otherwise(to)
    moves = files.select("path", to.alias("to")).where("to is not null")
    held = files.join(moves.select("path"), "path", "left_anti").select(F.col("path").alias("to"), F.lit(True).alias("_held"))
    twice = moves.groupBy("to").agg(F.count(F.lit(1)).alias("_n"))
    rows = moves.join(held, "to", "left").join(twice, "to")
    return rows.select("path", "to", (F.col("_held").isNotNull() | (F.col("_n") > 1)).alias("conflict"))


def needed_features(edges: DataFrame) -> DataFrame:
    """(feature, needs) of a graph (feature, needs), directly or by others: closed, whatever the depth."""
    up = closure(edges.select(F.col("feature").alias("id"), F.col("needs").alias("parent")))
    return up.where("id <> ancestor").select(F.col("id").alias("feature"), F.col("ancestor").alias("needs"))


def pending(batches: DataFrame, items: DataFrame, head: int = 12) -> DataFrame:
    """(batch, n, first) of the batches (batch) with their items (batch, place, item): how many, and the first `head` in order."""
    n = items.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    some = M.best_per(items, ["batch"], [F.col("place")], head).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("_f"))  # `head` at most
    return batches.join(n, "batch", "left").join(some, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("_f.item"), F.array().cast("array<string>")).alias("first"))


def chosen_workers(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """(job, worker) of jobs (job, source) by workers (worker, source, primary, device, load): the primary one of the source, then the owner of its
    device, then any, the least loaded first, ties by name. Workers of a source are few."""
    order = F.struct(F.when(F.col("primary"), 0).when(F.col("device"), 1).otherwise(2).alias("o"), "load", "worker")
    best = workers.groupBy("source").agg(F.min(order).alias("b")).select("source", "b.worker")
    return jobs.join(best, "source", "left").select("job", "worker")


def typed_setting(raw: Column, kind: str, default, low: float | None = None, high: float | None = None) -> Column:
    """A stored text as a number, flag or text of its kind, within bounds; the default where it can't be read."""
    if kind == "bool":
        return F.coalesce(F.when(F.lower(raw).isin("true", "1", "yes", "on"), True).when(F.lower(raw).isin("false", "0", "no", "off"), False), F.lit(default))
    value = F.coalesce(raw.try_cast({"int": "long", "float": "double", "text": "string"}[kind]), F.lit(default))
    value = F.greatest(value, F.lit(low)) if low is not None else value
    return F.least(value, F.lit(high)) if high is not None else value


def to_recut(faces: DataFrame, thumbs: DataFrame, version: int) -> DataFrame:
    """faces (id, box) whose picture (id, version) is missing or of another version; a face without a box can't be cut."""
    return faces.where("box is not null").join(thumbs.where(F.col("version") == version).select("id"), "id", "left_anti")
