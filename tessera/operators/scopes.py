"""Row selection: scopes, freshness, visibility, eligibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def folder(path: Column, scope: str, deep: bool = True) -> Column:
    """Files of a folder, with those below it if deep; the test reaches the scan as a prefix."""
    return path.startswith(P.prefix(scope)) & (F.lit(True) if deep else ~F.substring(path, len(P.prefix(scope)) + 1, 1 << 20).contains("/"))


def job(path: Column, roots: list[str], files: list[str]) -> Column:
    """Files under any of the roots, or named."""
    return any_of(*(P.inside(path, r) for r in roots), path.isin(files) if files else F.lit(False))


def visible(df: DataFrame, hidden: DataFrame, key: str = "path", show: str = "visible") -> DataFrame:
    """Rows that aren't hidden, only hidden ones, or all: show is `visible`, `hidden` or `all`."""
    if show == "all":
        return df
    return df.join(hidden.select(key).distinct(), key, "left_semi" if show == "hidden" else "left_anti")


def shard(key: Column, index: int, count: int) -> Column:
    """The rows of one shard by a hash: shards are disjoint and cover all."""
    return F.pmod(F.xxhash64(key), F.lit(count)) == index


def even_shards(df: DataFrame, key: str, count: int) -> DataFrame:
    """df with `shard`, sizes differing by one at most: rows are ranked within buckets of a hash and then over bucket sizes."""
    bucket = F.pmod(F.xxhash64(key), F.lit(1024))
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 1024 rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    placed = ranked.join(F.broadcast(sizes.withColumn("_before", before).drop("_n")), "_bucket")
    return placed.withColumn("shard", F.pmod(F.col("_before") + F.col("_rank"), F.lit(count)).cast("int")).drop("_bucket", "_rank", "_before")


def stale(wanted: DataFrame, done: DataFrame, key: str, version: list[str], ok: Column | None = None) -> DataFrame:
    """Rows of wanted without a result of the same version (null-safe) in done; ok tells usable results."""
    usable = done.where(ok) if ok is not None else done
    same = reduce(lambda a, b: a & b, (wanted[c].eqNullSafe(usable[c]) for c in version), wanted[key] == usable[key])
    return wanted.join(usable, same, "left_anti")


def signature(*inputs: Column) -> Column:
    """SHA-1 of the inputs' canonical JSON: equal inputs, equal signature."""
    return F.sha1(F.to_json(F.struct(*(c.alias(f"i{n}") for n, c in enumerate(inputs))), {"ignoreNullFields": "false"}))


def funnel(df: DataFrame, rules: list[tuple[Column, str]], passed: str = "passed") -> DataFrame:
    """(reason, n): how many rows each first failing rule rejects, and how many pass."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for rule, name in rules[1:]:
        out = out.when(rule, F.lit(name))
    return df.groupBy(out.otherwise(F.lit(passed)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def prompt_states(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(model, missing, current): how many of the expected prompts (name, text) each model of stored (model, name, text) lacks or has with another text.

    A model without any stored prompt isn't listed. What is stored and not expected doesn't count.
    """
    good = stored.join(expected.select("name", "text").distinct(), ["name", "text"], "left_semi").groupBy("model").agg(F.count_distinct("name").alias("_good"))
    wanted = expected.agg(F.count_distinct("name").alias("_wanted"))
    rows = stored.select("model").distinct().join(good, "model", "left").join(F.broadcast(wanted), F.lit(True))  # one row
    missing = F.col("_wanted") - F.coalesce("_good", F.lit(0))
    return rows.select("model", missing.alias("missing"), (missing == 0).alias("current"))
