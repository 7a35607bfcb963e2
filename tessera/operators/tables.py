"""Table upkeep as DataFrame to DataFrame: upserts, propagation, re-keying, merging. Writers swap snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshots import written


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows, and old's whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old's rows, and new's whose key old doesn't have."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def merge_known(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key; a value that new doesn't know stays as it was."""
    columns = [c for c in old.columns if c not in key]
    o, n = old.select(*key, *(F.col(c).alias(f"_old_{c}") for c in columns)), new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return o.join(n, key, "full_outer").select(*key, *(F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in columns))


def reset_changed(old: DataFrame, new: DataFrame, key: str, version: list[str], dependent: list[str]) -> DataFrame:
    """new's keys and versions; dependent values of old stay only where the version is the same."""
    o = old.select(F.col(key), *(F.col(c).alias(f"_old_{c}") for c in [*version, *dependent]))
    same = F.lit(True)
    for c in version:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    kept = new.join(o, key, "left")
    return kept.select(key, *version, *(F.when(same, F.col(f"_old_{c}")).alias(c) for c in dependent))


def copies(df: DataFrame, content: str, key: str) -> DataFrame:
    """(key, original) of rows whose content a smaller key has. The smallest key is found by a combinable minimum."""
    first = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(key).alias("original"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return df.join(first.drop("_n"), content).where(F.col(key) > F.col("original")).select(key, "original")


def repeated(df: DataFrame, column: str, most: int = 1_000_000) -> DataFrame:
    """df without rows whose value of a column stands alone, as a cheap test before a dear one: wide rows don't move for it.

    Up to `most` repeated values are broadcast. If there are more, hardly a row would go, and df is returned as it is: what
    follows must be right with such rows too. Rows without a value count as having one and the same.
    """
    values = df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_value")
    if values.limit(most + 1).count() > most:
        return df
    return df.join(F.broadcast(values), F.col(column).eqNullSafe(F.col("_value")), "left_semi")


def propagate(results: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """results, with those of originals for copies that have none."""
    new = results.join(pairs.select(F.col(key).alias("_copy"), F.col("original").alias(key)), key).drop(key).withColumnRenamed("_copy", key)
    return insert_missing(results, new.select(*results.columns), [key])


def rekeyed(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df with keys renamed by mapping (old, new); others stay."""
    renamed = df.join(mapping.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
    return renamed.withColumn(key, F.coalesce("_new", key)).select(*df.columns)


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the rank of each row from 1 by a column without repeats: rows are dealt to ranges and written, counted by range,
    and ranked inside each from what the ranges before it hold. No task holds more than its range."""
    dealt = written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, rank + F.col("_before")).drop("_range", "_before")


def standings(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, below, total, median) of every value of each group: how many rows have a smaller one, of how many, and the middle.

    Values are counted first, dealt to ranges of (group, value) and written; what stands before a range comes from one sum per range and
    group. So a group may hold most rows: no task holds more than its range of different values. Rows without a value don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(F.col(group), F.col(value)).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_range", group).agg(F.sum("_n").alias("_sum"))  # a row per group, and one per range more
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_range", group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(group)).alias("total"))
    inside = Window.partitionBy("_range", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, ["_range", group]).withColumn("below", F.col("_before") + F.col("_in"))
    holds = lambda at: (F.col("below") <= at) & (F.col("below") + F.col("_n") > at)
    middle = ranks.where(holds(F.floor((F.col("total") - 1) / 2)) | holds(F.floor(F.col("total") / 2))).groupBy(group).agg((F.min(value) * 0.5 + F.max(value) * 0.5).alias("median"))
    return ranks.select(group, value, "below", "total").join(middle, group)


def replaced(old: DataFrame, new: DataFrame, key: str, ident: str) -> DataFrame:
    """new's groups under old's ids where the key is known, else under the next free ones; an empty new keeps old."""
    if new.isEmpty():
        return old
    known = new.join(old.select(key, ident), key, "left")
    top = old.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    fresh = ranked(known.where(F.col(ident).isNull()), key, "_rank")
    fresh = fresh.join(F.broadcast(top), F.lit(True)).withColumn(ident, F.col("_top") + F.col("_rank")).drop("_top", "_rank")
    return known.where(F.col(ident).isNotNull()).unionByName(fresh)


def found_or_created(names: DataFrame, people: DataFrame) -> DataFrame:
    """people(id, name) with the names that it lacks, under new ids in order of name."""
    missing = names.select("name").where("name is not null").distinct().join(people, "name", "left_anti")
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = ranked(missing, "name", "_rank").join(F.broadcast(top), F.lit(True))
    return people.select("id", "name").union(fresh.select(F.col("_top") + F.col("_rank"), "name"))


def overridden(computed: DataFrame, manual: DataFrame, groups: DataFrame, key: str, value: str) -> DataFrame:
    """Values with manual ones first, applied to every row of the group (key, group) of a marked row."""
    by_group = groups.join(manual.select(key, F.col(value).alias("_manual")), key).groupBy("group").agg(F.max("_manual").alias("_manual"))
    rows = computed.join(groups.select(key, "group"), key, "left").join(by_group, "group", "left")
    return rows.select(key, F.coalesce("_manual", value).alias(value), F.col("_manual").isNotNull().alias("manual"))


def reconciled(scan: DataFrame, known: DataFrame, key: str, version: list[str], complete: Column) -> DataFrame:
    """(key, state) of a scan against the catalogue: new, changed, known, or missing where the scan was complete, else kept."""
    s = scan.select(key, *(F.col(c).alias(f"_s_{c}") for c in version), F.lit(True).alias("_s"))
    k = known.select(key, *(F.col(c).alias(f"_k_{c}") for c in version), F.lit(True).alias("_k"))
    both = s.join(k, key, "full_outer")
    same = F.lit(True)
    for c in version:
        same = same & F.col(f"_s_{c}").eqNullSafe(F.col(f"_k_{c}"))
    state = F.when(F.col("_k").isNull(), "new").when(F.col("_s").isNull(), F.when(complete, F.lit("missing")).otherwise(F.lit("kept"))).when(same, "known").otherwise("changed")
    return both.select(key, state.alias("state"))
