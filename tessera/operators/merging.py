"""Two catalogues to one: ids, people by name, album trees by title, folders by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .snapshots import written


def offset_ids(own: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """(key, new) of the other table's rows: ids go on after the highest own."""
    top = F.broadcast(own.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top")))  # one row
    return other.select(key).join(top, F.lit(True)).select(key, (F.col(key) + F.col("_top")).alias("new"))


def same_names(own: DataFrame, other: DataFrame) -> DataFrame:
    """(id, new, known) of the other's people (id, name): one of the same name (the least id) is the same person, others get new ids."""
    known = own.where("name is not null").groupBy("name").agg(F.min("id").alias("_known"))
    rows = other.join(known, "name", "left").join(offset_ids(own, other), "id")
    return rows.select("id", F.coalesce("_known", "new").alias("new"), F.col("_known").isNotNull().alias("known"))


def same_titles(own: DataFrame, other: DataFrame) -> DataFrame:
    """(id, new, known) of the other's albums (id, parent, title): an album is the same where its parent is and the title, level by
    level; others get new ids, and so does all below them."""
    home = written(own.groupBy(F.coalesce("parent", F.lit(-1)).alias("_at"), "title").agg(F.min("id").alias("_known")))
    fresh = offset_ids(own, other)
    rows = written(other.select("id", "parent", "title").join(fresh, "id"))
    level = rows.where("parent is null").withColumn("_at", F.lit(-1).cast("long"))
    out = None
    while True:
        level = written(level.join(home, ["_at", "title"], "left").select("id", F.coalesce("_known", "new").alias("to"), F.col("_known").isNotNull().alias("known")))
        if level.isEmpty():
            return out.select("id", F.col("to").alias("new"), "known") if out is not None else level.select("id", F.col("to").alias("new"), "known")
        out = level if out is None else out.union(level)
        above = level.select(F.col("id").alias("parent"), F.when(F.col("known"), F.col("to")).otherwise(-2).alias("_at"))
        level = rows.join(above, "parent").select("id", "parent", "title", "new", F.col("_at").cast("long").alias("_at"))


def rewritten(df: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """df with ids in the named columns replaced by mappings (id, new); what a mapping lacks stays."""
    for column, mapping in columns.items():
        named = mapping.select(F.col("id").alias(column), F.col("new").alias("_new"))
        df = df.join(named, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return df


def keyed(path: Column, source: str) -> Column:
    """A path as a key of the source; what is a key already, empty or null stays."""
    return F.when((path == "") | P.is_key(path), path).otherwise(F.concat(F.lit(f"{source}:"), path))


def keyed_columns(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """df of one computer's catalogue with the paths in these columns as keys of its source: only those whose colon is a drive's, or that have none."""
    head = F.lit(f"{source}:")
    for column in columns:
        path = F.col(column)
        df = df.withColumn(column, F.when((path != "") & P.is_legacy(path), F.concat(head, path)).otherwise(path))
    return df


def keyed_list(items: Column, source: str) -> Column:
    """A run's list of roots or paths as keys of the source."""
    return F.transform(items, lambda x: keyed(x, source))


def keyed_rules(rules: Column, source: str) -> Column:
    """Path rules, one a line, as rules of the source: lines are trimmed, empty ones inside stay, those at both ends go."""
    lines = F.transform(F.split(F.replace(rules, F.lit("\r"), F.lit("")), "\n"), lambda x: keyed(F.regexp_replace(x, r"^\s+|\s+$", ""), source))
    return F.trim(F.array_join(lines, "\n"), F.lit("\n"))
