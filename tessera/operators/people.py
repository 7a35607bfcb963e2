"""The whole identity build: tracks of files and stills to named, labelled people.

1. Each file's tracks become identities (`identities.file_identities`). An identity, or a still, is a unit with a few vectors.
2. Units are named after the people whose confirmed views they are like. Views of the unit's own file never speak for it, and of a
   person's periods the nearest counts.
3. Units are clustered by their vectors, over all files.
4. Clusters are mended: units that must be apart, have different names, or are not alike by their several vectors, are parted again.
5. The groups get the labels that most of their members had before.

What must be apart shares a scene: two tracks a moment of a file, two stills a picture, two keys kept apart by hand a scene made for them. So
constraints are rows of (key, scene) and not pairs, and a group breaks none if no two of its units share a scene.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import identities as I
from .clusters import clustered, pair_score, stable_labels
from .near import units

#: Thresholds and margins of naming and mending, and the width of a period in years.
RULES = {
    "named": 0.78, "named_margin": 0.10, "child_margin": 0.14, "aged": 0.86, "years": 3,
    "stitch": I.STITCH, "single": I.SINGLE, "group_floor": 0.55, "distance": 0.70, "least_group": 8,
}
#: Views of people that are broadcast at once; of more, blocks of people meet the units one after another.
MOST_VIEWS = 20_000
NO_YEAR = 10_000

Checkpoint = Callable[[DataFrame], DataFrame]


@dataclass
class Build:
    """identities: (file, track, identity, role). units: (unit, file, still, members). names: (unit, person, confidence, manual).
    labels: (key, label), -1 for keys without a group."""

    identities: DataFrame
    units: DataFrame
    names: DataFrame
    labels: DataFrame


def diverse_banks(rows: DataFrame, group: list[str], checkpoint: Checkpoint, most: int = I.BANK) -> DataFrame:
    """(group, bank, n): of each group's rows (group, key, weight, vector) up to `most` vectors, one a round: the one of most weight, lowered by half
    as far as it is like a chosen one; none that equals a chosen one (ties: more weight, smaller key).

    Each round takes a maximum a group, combined before it is shuffled, so that no group is gathered.
    """
    banks = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("bank", F.array().cast("array<array<double>>"))
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] if other else group
    for _ in range(most):
        met = rows.join(banks.select(*(F.col(c).alias(f"_{c}") for c in group), "bank"), same(True)).drop(*(f"_{c}" for c in group))
        like = F.array_max(F.transform("bank", lambda b: V.dot(b, F.col("vector"))))
        met = met.withColumn("_like", like).where(F.col("_like").isNull() | (F.col("_like") < I.SAME))
        worth = F.col("weight") * (1 - F.coalesce("_like", F.lit(0.0)) / 2)
        pick = met.groupBy(*group).agg(F.max_by("vector", F.struct(worth, "weight", -F.col("key"))).alias("_pick"))
        pick = pick.select(*(F.col(c).alias(f"_{c}") for c in group), "_pick")
        banks = checkpoint(banks.join(pick, same(True), "left").select(*group, "n", F.when(F.col("_pick").isNull(), F.col("bank")).otherwise(F.concat("bank", F.array("_pick"))).alias("bank")))
    return banks


def profiles(views: DataFrame, checkpoint: Checkpoint, years: int = RULES["years"]) -> DataFrame:
    """(person, without, periods) of confirmed views (person, key, file, year, weight, vector): periods is an array of (start, n, bank), start 0
    where the year isn't known. `without` null: from all files; else the profile that a unit of that file is held against.

    A bank changes only if the left-out file has a view in it: only such banks are chosen anew.
    """
    unit_views = views.withColumn("vector", V.unit(F.col("vector"))).where("vector IS NOT NULL AND person IS NOT NULL")
    period = F.when(F.col("year").isNull(), 0).otherwise(F.col("year") - F.pmod("year", F.lit(years))).cast("int")
    unit_views = checkpoint(unit_views.select("person", period.alias("period"), "file", "key", "weight", "vector"))
    base = diverse_banks(unit_views, ["person", "period"], checkpoint)
    shown = unit_views.join(base.select("person", "period", F.explode("bank").alias("vector")), ["person", "period", "vector"]).select("person", "period", F.col("file").alias("without")).distinct()
    others = unit_views.join(shown, ["person", "period"]).where(~F.col("file").eqNullSafe(F.col("without")))
    changed = diverse_banks(others, ["person", "period", "without"], checkpoint).select("person", "period", "without", F.col("bank").alias("changed"))
    changed = shown.join(changed, ["person", "period", "without"], "left").select("person", "period", "without", F.coalesce("changed", F.array().cast("array<array<double>>")).alias("changed"))
    own = unit_views.groupBy("person", "period", F.col("file").alias("without")).agg(F.count(F.lit(1)).alias("mine")).where("without IS NOT NULL")
    each = own.select("person", "without").distinct().join(base, "person").join(own, ["person", "period", "without"], "left").join(changed, ["person", "period", "without"], "left")
    each = each.select("person", "without", "period", (F.col("n") - F.coalesce("mine", F.lit(0))).alias("n"), F.coalesce("changed", "bank").alias("bank")).where("n > 0")
    every = base.select("person", F.lit(None).cast(dict(views.dtypes)["file"]).alias("without"), "period", "n", "bank").unionByName(each)
    return every.groupBy("person", "without").agg(F.sort_array(F.collect_list(F.struct(F.col("period").alias("start"), "n", "bank"))).alias("periods"))


def _aged(periods: list, limit: float) -> bool:
    """Whether a person's views change with the years: the centres of two well-known periods are less alike than `limit`."""
    centres = [np.mean([np.asarray(v) for v in p["bank"]], axis=0) for p in periods if p["start"] and len(p["bank"]) and p["n"] >= 2]
    centres = [c / max(np.linalg.norm(c), 1e-12) for c in centres]
    return len(centres) > 1 and min(a @ b for i, a in enumerate(centres) for b in centres[:i]) < limit


def _nearest(periods: list, year: float | None) -> list:
    """Views of the period that starts nearest to the year; of all, where the year isn't known."""
    if year is None or np.isnan(year):
        return [v for p in periods for v in p["bank"]]
    return min(periods, key=lambda p: abs(p["start"] - year) if p["start"] else NO_YEAR)["bank"]


def likeness(sims: np.ndarray, most: int = I.PAIRS) -> tuple[float, int]:
    """Of a unit's vectors (rows) and a person's views (columns): mean and number of the best views of a single vector, or of the best pairs
    in which each vector and each view stands once."""
    if not sims.size:
        return -1.0, 0
    if len(sims) == 1:
        best = np.sort(sims[0])[::-1][:most]
        return float(best.mean()), len(best)
    count = min(most, *sims.shape)
    return pair_score(sims, np.eye(sims.shape[1]), most), count


def likest_people(rows: DataFrame, known: DataFrame, p: dict, most_views: int = MOST_VIEWS) -> DataFrame:
    """(unit, person, score, support, margin, lead) of units (unit, file, year, bank): the likest person of each, by how much it leads, and how
    much it must lead."""
    size = known.select(F.sum(F.aggregate("periods", F.lit(0), lambda s, x: s + F.size(x["bank"])))).first()[0] or 0
    blocks = max(1, -(-2 * size // most_views)) if size > most_views else 1
    kinds, spark = dict(known.dtypes) | dict(rows.dtypes), rows.sparkSession
    out = f"unit {kinds['unit']}, person {kinds['person']}, score double, support int, margin double"
    found = None
    for block in range(blocks):
        # People of one block; those of a block are views in memory, at most `most_views` on average half of it.
        some = known.where(F.pmod(F.xxhash64("person"), F.lit(blocks)) == block).collect()
        people: dict = {}
        for r in some:
            people.setdefault(r.person, {})[r.without] = (r.periods, p["child_margin"] if _aged(r.periods, p["aged"]) else p["named_margin"])
        shared = spark.sparkContext.broadcast(people)

        def scored(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for part in batches:
                best = []
                for r in part.itertuples(index=False):
                    mine = np.vstack([np.asarray(v) for v in r.bank])
                    own = []
                    for person, variants in shared.value.items():
                        periods, margin = variants.get(r.file) or variants.get(None) or ([], p["named_margin"]) if r.file is not None else variants.get(None, ([], p["named_margin"]))
                        views = _nearest(periods, r.year) if len(periods) else []
                        score, support = likeness(mine @ np.vstack([np.asarray(v) for v in views]).T) if len(views) else (-1.0, 0)
                        own.append((r.unit, person, score, support, margin))
                    best += sorted(own, key=lambda x: (-x[2], x[1]))[:2]
                yield pd.DataFrame(best, columns=["unit", "person", "score", "support", "margin"])

        now = rows.select("unit", "file", F.col("year").cast("double").alias("year"), "bank").mapInPandas(scored, out)
        found = now if found is None else found.union(now)
    order = Window.partitionBy("unit").orderBy(F.desc("score"), "person")  # two rows a block
    ranked = found.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    top = F.max(F.when(F.col("rank") == 1, F.struct("person", "score", "support", "margin"))).alias("b")
    return ranked.groupBy("unit").agg(top, second.alias("second")).select("unit", "b.*", (F.col("b.score") - F.coalesce("second", F.lit(-1.0))).alias("lead"))


def named_units(rows: DataFrame, members: DataFrame, scenes: DataFrame, given: DataFrame, known: DataFrame, p: dict) -> DataFrame:
    """(unit, person, confidence, manual) of units (unit, still, file, year, bank).

    A unit whose members were given one name has it. Another takes the likest person's, if sure enough, ahead enough of the second, and (for a
    still) borne out by two views. Of units in one scene that would have one name, the given, then the surest, keeps it.
    """
    manual = members.join(given.where("person IS NOT NULL"), "key").groupBy("unit").agg(F.min("person").alias("_low"), F.max("person").alias("_high"))
    like = likest_people(rows, known, p)
    both = rows.select("unit", "still").join(manual, "unit", "left").join(like, "unit", "left")
    sure = (F.col("score") >= p["named"]) & (F.col("lead") >= F.col("margin")) & (~F.col("still") | (F.col("support") >= 2))
    is_given = F.coalesce(F.col("_low") == F.col("_high"), F.lit(False))
    claims = both.select("unit", F.when(is_given, F.col("_low")).when(sure, F.col("person")).alias("person"), F.when(is_given, 1.0).otherwise(F.col("score")).alias("confidence"), is_given.alias("manual")).where("person IS NOT NULL")
    place = Window.partitionBy("scene", "person").orderBy(F.desc("manual"), F.desc("confidence"), "unit")  # units of one scene
    spots = claims.join(members, "unit").join(scenes, "key").select("unit", "person", "confidence", "manual", "scene").distinct()
    lost = spots.withColumn("rank", F.row_number().over(place)).where("rank > 1").select("unit").distinct()
    return claims.join(lost, "unit", "left_anti")


def first_fit(fits: np.ndarray) -> np.ndarray:
    """Part of each row: the first part all of whose members it fits (a symmetric matrix of truths), else a new one."""
    part, sets = np.zeros(len(fits), int), []
    for i, row in enumerate(fits):
        part[i] = next((k for k, members in enumerate(sets) if row[members].all()), len(sets))
        if part[i] == len(sets):
            sets.append([])
        sets[part[i]].append(i)
    return part


def compatible(g: pd.DataFrame, p: dict) -> np.ndarray:
    """Which two units of a cluster may stand together; columns file, still, person, bank, cores, scenes."""
    n = len(g)
    names = pd.factorize(g["person"])[0]
    fits = (names[:, None] == names) | (names[:, None] < 0) | (names < 0)
    scene = [set(s) for s in g["scenes"]]
    where: dict = {}
    for i, own in enumerate(scene):
        for s in own:
            where.setdefault(s, []).append(i)
    for together in where.values():
        fits[np.ix_(together, together)] = False
    still, file = g["still"].to_numpy(bool), g["file"].to_numpy()
    banks = [np.vstack([np.asarray(v) for v in b]) for b in g["bank"]]
    cores = [[np.vstack([np.asarray(v) for v in b]) for b in c] for c in g["cores"]]
    for i in range(n):
        for j in range(i):
            if not fits[i, j] or (still[i] and still[j]):
                continue
            alike = pair_score(banks[i], banks[j], I.PAIRS) >= (p["stitch"] if min(len(banks[i]), len(banks[j])) > 1 else p["single"])
            if alike and not still[i] and not still[j] and file[i] == file[j]:
                alike = all(pair_score(a, b, I.PAIRS) >= p["stitch"] for a in cores[i] for b in cores[j])
            fits[i, j] = fits[j, i] = alike
    np.fill_diagonal(fits, True)
    return fits


def mended(rows: DataFrame, p: dict) -> DataFrame:
    """(unit, group) of units (cluster, unit, file, still, person, vector, bank, cores, scenes): each cluster in the order identities, stills, by file and
    unit, cut into groups that break no constraint. A group of stills alone is cut once more, until all its members are alike, and needs
    `least_group` of them. Group is the least unit in it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["still", "file", "unit"]).reset_index(drop=True)
        part = first_fit(compatible(g, p))
        still, unit, v = g["still"].to_numpy(bool), g["unit"].to_numpy(), units(g["vector"])
        out = []
        for k in range(part.max() + 1):
            own = np.flatnonzero(part == k)
            fine = np.zeros(len(own), int) if not still[own].all() else I.first_fit(v[own], p["group_floor"])
            for f in np.unique(fine):
                group = own[fine == f]
                if not still[group].all() or len(group) >= p["least_group"]:
                    out += [(u, unit[group].min()) for u in unit[group]]
        return pd.DataFrame(out, columns=["unit", "group"])

    kind = dict(rows.dtypes)["unit"]
    return rows.groupBy("cluster").applyInPandas(run, f"unit {kind}, group {kind}")


def build(samples: DataFrame, stills: DataFrame, given: DataFrame, old: DataFrame, checkpoint: Checkpoint, people: str | None = None, apart: DataFrame | None = None, highest: int | None = None, most_rows: int = 12_000, **rules: float) -> Build:
    """The build over samples (file, track, ts, quality, core, vector, year) of tracks and stills (file, key, quality, vector, year).

    given: (key, person) names by hand. old: (key, label) of the last build. people: the column of samples with the hint of a file's number of
    people. apart: (a, b) keys kept apart by hand. Tracks and stills have keys of one numbering (long). Rules override RULES.

    Rows without key, file or vector take no part in units; keys without a group have label -1. Empty tables give empty ones. A file's
    tracks are one task's work, and so are the units of one cluster (at most `most_rows`).
    """
    p = RULES | rules
    tracks = samples.where("track IS NOT NULL AND vector IS NOT NULL AND file IS NOT NULL")
    pictures = stills.where("key IS NOT NULL AND vector IS NOT NULL AND file IS NOT NULL").withColumn("vector", V.unit(F.col("vector"))).where("vector IS NOT NULL")
    scene = lambda kind, *c: F.concat_ws(":", F.lit(kind), *(F.col(x).cast("string") for x in c))
    scenes = tracks.where("ts IS NOT NULL").select(F.col("track").alias("key"), scene("moment", "file", "ts").alias("scene")).union(pictures.select("key", scene("picture", "file").alias("scene")))
    if apart is not None:
        named = scene("pair", "a", "b")
        scenes = scenes.union(apart.select(F.col("a").alias("key"), named.alias("scene"))).union(apart.select(F.col("b").alias("key"), named.alias("scene")))
    scenes = checkpoint(scenes.distinct())
    once = given.where("key IS NOT NULL").groupBy("key").agg(F.min("person").alias("person"))
    more = scenes.where("scene LIKE 'pair:%'").groupBy("key").agg(F.collect_list("scene").alias("scenes")).withColumnRenamed("key", "track")
    told = tracks.join(once.withColumnRenamed("key", "track"), "track", "left").join(more, "track", "left")
    found = checkpoint(I.file_identities(told, "file", p["stitch"], people, person="person", apart="scenes"))

    placed = found.where("identity >= 0")
    unit = placed.groupBy("file", "identity").agg(F.min("track").alias("unit"), F.max((F.col("role") == "core").cast("int")).alias("_cored"))
    placed = placed.join(unit, ["file", "identity"])
    rows = tracks.join(placed.where("role = 'core' OR _cored = 0").select("file", "track", "unit", "role"), ["file", "track"])

    def banked(g: pd.DataFrame) -> pd.DataFrame:
        quality, v = g["quality"].fillna(0).to_numpy(float), units(g["vector"])
        bank = v[I.varied(quality, v)]
        centre = bank.mean(axis=0)
        cores = [v[at][I.varied(quality[at], v[at])].tolist() for at in (np.flatnonzero(g["track"] == t) for t in sorted(g.loc[g["role"] == "core", "track"].unique()))]
        return pd.DataFrame({"unit": [g["unit"].iloc[0]], "file": [g["file"].iloc[0]], "year": [g["year"].max()], "bank": [bank.tolist()], "vector": [(centre / max(np.linalg.norm(centre), 1e-12)).tolist()], "cores": [cores]})

    file_kind = dict(samples.dtypes)["file"]
    shown = rows.groupBy("unit").applyInPandas(banked, f"unit long, file {file_kind}, year double, bank array<array<double>>, vector array<double>, cores array<array<array<double>>>")
    none = F.array().cast("array<array<array<double>>>")
    alone = pictures.select(F.col("key").alias("unit"), "file", F.col("year").cast("double").alias("year"), F.array("vector").alias("bank"), "vector", none.alias("cores"))
    every = checkpoint(shown.withColumn("still", F.lit(False)).unionByName(alone.withColumn("still", F.lit(True))))
    members = checkpoint(placed.select("unit", F.col("track").alias("key")).union(pictures.select(F.col("key").alias("unit"), "key")))

    views = tracks.where("core").select(F.col("track").alias("key"), "file", "year", "quality", "vector").unionByName(pictures.select("key", "file", "year", "quality", "vector"))
    views = views.join(once, "key").select("person", "key", "file", "year", F.coalesce("quality", F.lit(0.0)).alias("weight"), "vector")
    names = checkpoint(named_units(every, members, scenes, once, profiles(views, checkpoint, p["years"]), p))

    grouped = clustered(every.select(F.lit(0).alias("g"), F.col("unit").alias("key"), "vector"), "g", most_rows=most_rows, most=p["distance"], least=2)
    single = F.when(F.col("label") < 0, F.concat(F.lit("unit:"), F.col("key").cast("string"))).otherwise(F.concat(F.lit("cluster:"), F.col("label").cast("string")))
    in_scenes = members.join(scenes, "key").groupBy("unit").agg(F.collect_set("scene").alias("scenes"))
    full = every.join(grouped.select(F.col("key").alias("unit"), single.alias("cluster")), "unit").join(names.select("unit", "person"), "unit", "left").join(in_scenes, "unit", "left")
    full = full.withColumn("scenes", F.coalesce("scenes", F.array().cast("array<string>")))
    groups = checkpoint(mended(full, p))
    labels = checkpoint(members.join(groups, "unit").select("key", F.col("group").alias("label")))
    final = stable_labels(labels, old, checkpoint, highest)
    keys = tracks.select(F.col("track").alias("key")).union(stills.where("key IS NOT NULL").select("key")).distinct()
    labelled = keys.join(labels.join(final, "label").select("key", "final"), "key", "left").select("key", F.coalesce("final", F.lit(-1)).alias("label"))
    return Build(found, every.select("unit", "file", "still").join(members.groupBy("unit").agg(F.sort_array(F.collect_list("key")).alias("members")), "unit"), names, labelled)
