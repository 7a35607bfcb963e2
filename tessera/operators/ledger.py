"""Books that a catalogue keeps: runs over roots, batches for review, versions of models, and cleaning by source."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Columns of the run history.
RUNS = "roots array<string>, paths array<string>, first_run timestamp, last_run timestamp, runs long, last array<string>, done array<string>, status string"
#: Sizes that a batch may have, and the one that stands for all others.
SIZES, USUAL = (1, 3, 5, 10, 15, 20), 10
#: Fixed value: days after which a batch that nobody answered stops reserving its files.
DAYS = 7


def runs_started(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """The history (RUNS) after starts (roots, paths, features, at): one row per roots and paths, counted up where it is known.

    A start ends what was running as `interrupted`, so of many starts only the last (ties: the greater roots, then paths) is left `running`.
    A known row keeps its first time and what it has done; its last time and features are the latest start's. No start changes nothing.
    """
    key = ["roots", "paths"]
    new = starts.groupBy(*key).agg(F.min("at").alias("_from"), F.max(F.struct("at", F.array_sort("features").alias("features"))).alias("_to"), F.count(F.lit(1)).alias("_n"))
    last = starts.agg(F.max(F.struct("at", *key)).alias("_l")).select("_l.roots", "_l.paths", F.lit(True).alias("_running")).where("roots IS NOT NULL")
    marked = new.join(F.broadcast(last), key, "left")  # one row
    rows = runs.join(marked, key, "full_outer").join(F.broadcast(last.select(F.lit(True).alias("_any"))), F.lit(True), "left")
    stopped = F.when(F.col("_any") & ((F.col("status") == "running") | F.col("_n").isNotNull()), "interrupted").otherwise(F.col("status"))
    return rows.select(
        *key,
        F.coalesce("first_run", "_from").alias("first_run"),
        F.coalesce("_to.at", "last_run").alias("last_run"),
        (F.coalesce("runs", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("runs"),
        F.coalesce("_to.features", "last").alias("last"),
        F.coalesce("done", F.array().cast("array<string>")).alias("done"),
        F.when(F.col("_running"), "running").otherwise(stopped).alias("status"),
    )


def runs_finished(runs: DataFrame, status: str) -> DataFrame:
    """The history after the running row has ended: if `completed`, what it did joins what was done before."""
    running = F.col("status") == "running"
    done = F.array_sort(F.array_union("done", "last")) if status == "completed" else F.col("done")
    return runs.withColumn("done", F.when(running, done).otherwise(F.col("done"))).withColumn("status", F.when(running, F.lit(status)).otherwise(F.col("status")))


def files_in_roots(runs: DataFrame, files: DataFrame) -> DataFrame:
    """runs (roots, paths, ...) with `files`: how many of the files (path) lie in any of a run's roots, or how many paths it names without roots.

    A root that lies in another of the same run, or repeats it, is left out, so that counts add up. Files are counted by folder, folders are
    spread over those above them, and roots meet them by equality: a range join without ranges, whose shuffle holds folders.
    """
    separated = lambda r: F.concat(P.trimmed(r), F.when(P.trimmed(r).rlike(r"[\\/]$"), F.lit("")).otherwise(P.separator(r)))
    trimmed = F.array_distinct(F.transform("roots", P.trimmed))
    roots = F.filter(trimmed, lambda r: ~F.exists(trimmed, lambda o: (o != r) & r.startswith(separated(o))))
    wanted = runs.select("roots", "paths", F.explode(roots).alias("folder")).distinct()
    named = files.select("path").where("path IS NOT NULL").distinct()
    direct = named.groupBy(P.parent(F.col("path")).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    below = direct.select(F.explode(F.array_distinct(F.transform(P.chain(F.col("own")), P.trimmed))).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n"))
    itself = named.join(wanted.select(F.col("folder").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("folder"), F.lit(1).cast("long").alias("n"))
    totals = below.join(wanted.select("folder").distinct(), "folder", "left_semi").union(itself)
    counts = wanted.join(totals, "folder").groupBy("roots", "paths").agg(F.sum("n").alias("_files"))
    some = F.size("roots") > 0
    return runs.join(counts, ["roots", "paths"], "left").select(*runs.columns, F.when(some, F.coalesce("_files", F.lit(0))).otherwise(F.size("paths")).cast("long").alias("files"))


def expired(batches: DataFrame, now: datetime, days: int = DAYS) -> DataFrame:
    """batches (id, status, created, ...): those still `exported` after so many days are `expired`."""
    old = (F.col("status") == "exported") & (F.col("created") < F.lit(now - timedelta(days=days)))
    return batches.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def cancelled(batches: DataFrame, chosen: DataFrame) -> DataFrame:
    """batches, those of chosen (id) `cancelled` if they are `exported`; answered, expired and cancelled ones stay as they are."""
    hit = batches.join(chosen.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when((F.col("status") == "exported") & F.col("_hit"), "cancelled").otherwise(F.col("status"))).select(*batches.columns)


def reserved(batches: DataFrame, items: DataFrame) -> DataFrame:
    """(path) of items (id, path) in a batch that is `exported`: not to be put into another."""
    return items.join(batches.where("status = 'exported'").select("id"), "id", "left_semi").select("path").distinct()


def next_batch(queue: DataFrame, batches: DataFrame, items: DataFrame, size: int = USUAL) -> DataFrame:
    """(path, order) of the first files of a queue (path, order) that no batch reserves, each once; a size that isn't allowed is the usual one."""
    free = queue.groupBy("path").agg(F.min("order").alias("order")).join(reserved(batches, items), "path", "left_anti")
    return free.orderBy("order", "path").limit(size if size in SIZES else USUAL)


def activated(models: DataFrame, version: str, embedding: str) -> DataFrame:
    """models (version, embedding, status, ...) with one active version; what was active is a `candidate` again.

    Raises for a version that isn't there or was trained for another embedding.
    """
    at = models.where(F.col("version") == version).select("embedding").first()
    if at is None:
        raise ValueError(f"no version {version!r}")
    if at.embedding != embedding:
        raise ValueError(f"version {version!r} was trained for {at.embedding!r}")
    was = F.when(F.col("status") == "active", "candidate").otherwise(F.col("status"))
    return models.withColumn("status", F.when(F.col("version") == version, "active").otherwise(was))


def of_source(path: Column, source: str) -> Column:
    """Files of a source, pushed down as a prefix; with an empty source, those without any."""
    return path.startswith(source + ":") if source else P.is_legacy(path)


def cleaned(tables: dict[str, DataFrame], source: str, what: set[str], by_path: dict[str, list[str]], by_id: dict[str, tuple[str, str, list[str]]] | None = None, resets: dict[str, tuple[str, list[str]]] | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables without what was derived from a source's files, and (category, table, n): how many rows each category lost.

    by_path gives, for each category, its tables with a `path`. Rows of other tables go with the row that they name: by_id maps a table to its
    parent, the parent's id and the columns that hold one. resets says which columns of which table lose their values on the source's rows when a
    category goes, so that a later stage computes them again. `catalog` is everything. An unknown or empty choice raises, as does a
    source that couldn't be one. Tables that aren't given are passed over.
    """
    import re

    if source and not re.fullmatch("[a-z0-9][a-z0-9_-]{1,31}", source):
        raise ValueError(f"no source: {source!r}")
    if not what or what - {*by_path, "catalog"}:
        raise ValueError(f"choose among {sorted({*by_path, 'catalog'})}")
    chosen = set(by_path) if "catalog" in what else set(what)
    out, losses = dict(tables), []
    for category in sorted(chosen):
        for name in by_path[category]:
            if name not in tables:
                continue
            gone = of_source(F.col("path"), source)
            lost = tables[name].where(gone)
            losses.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(category).alias("category"), F.lit(name).alias("table"), "n"))
            out[name] = out[name].where(F.coalesce(~gone, F.lit(True)))
            for child, (parent, ident, columns) in (by_id or {}).items():
                if parent == name and child in tables:
                    for column in columns:
                        out[child] = out[child].join(lost.select(F.col(ident).alias(column)).distinct(), column, "left_anti").select(*tables[child].columns)
        name, columns = (resets or {}).get(category, ("", []))
        if name in tables:
            hit = of_source(F.col("path"), source)
            for column in columns:
                out[name] = out[name].withColumn(column, F.when(F.coalesce(~hit, F.lit(True)), F.col(column)))
    return out, reduce(DataFrame.union, losses) if losses else None
