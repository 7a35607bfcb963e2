"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

A block keeps, for each of `projections` random directions, its vectors in the order of their projections. A
query's window on a direction is centred on the query's own projection. By virtual rehashing the windows of all
directions widen together, by `GROWTH` a round, and only what comes into a window is counted; a vector whose collisions
reach the threshold is verified on the original vectors. A query stops once its windows are so wide that a vector as good
as the k-th best verified one collides often enough with a probability of SURE. Nothing else ends the search, so that the
number of verified vectors follows from how far the neighbours stand out and not from a share of the block.

Largest inner product becomes nearest distance by one more component: sqrt(M * M - |x|**2) for a
vector, 0 for a query, which is scaled to norm M. A block is cut into ranges of norms, each with its own M (its largest
norm) and sorted arrays, searched from the longest vectors down until no shorter one can reach the k-th best.

Vectors are dealt to blocks by the same kind of projection: one more direction halves the cells each time the table doubles,
and a cell that still is too large (copies) is split by a hash. A query first asks the block that it lies in. Its k-th best there
gives the width of its windows on the dealing directions, and only blocks that these reach are asked, all at once and each
in one round, since the width is known. A block is copied only if more than `query_block` queries reach it. The result
holds the k best over all blocks. Medians and the window unit are fitted on a bounded sample (`sample` vectors); every
vector is indexed.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import hash_sample, written

K, EVERY = 20, 20
PROJECTIONS, THRESHOLD, GROWTH = 96, 0.8, 1.2
BLOCK, QUERY_BLOCK, SAMPLE = 16384, 4096, 4096
#: Norms of one range differ by this factor at most.
RANGE = 1.1
#: Chances to verify a vector as good as the k-th best in a block, and to ask its block.
SURE, REACH = 0.9, 0.98
#: Windows wider than so many norms hold everything.
WIDEST = 1000.0


def _finite(vector: Column) -> Column:
    """Whether a vector is there, without null, infinite or undefined components, and not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lifted(vectors: np.ndarray, largest: np.ndarray | float) -> np.ndarray:
    return np.column_stack((vectors, np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))))


class Index:
    """Sorted projections of one block's range of norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray, largest: float) -> None:
        self.ids, self.vectors, self.directions, self.largest = ids, vectors, directions, largest
        self.rough = (vectors / largest).astype(np.float32)
        places = (_lifted(vectors, largest) @ directions).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, self.order, axis=1)
        self.rank = np.empty(self.order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids), dtype=self.rank.dtype)[None, :], axis=1)

    def _collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """In how many of the windows centre +- half each vector lies. A window is a range of ranks: narrow ones are read
        from the sorted arrays, for wide ones all ranks are compared."""
        edges = np.array([np.searchsorted(row, (c - half, c + half)) for row, c in zip(self.sorted, centre, strict=True)])
        low, high = edges[:, 0], edges[:, 1]
        if (high - low).sum() * 8 < self.rank.size:
            return np.bincount(np.concatenate([order[a:b] for order, a, b in zip(self.order, low, high, strict=True)]), minlength=len(self.ids))
        low, width = low.astype(self.rank.dtype)[:, None], (high - low).astype(self.rank.dtype)[:, None]
        return (self.rank - low < width).view(np.uint8).sum(axis=0, dtype=np.uint8)  # a rank below low wraps around

    def search(self, query: np.ndarray, own: int, k: int, unit: float | None, spread: float, best: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the vectors that collide often enough; best: the k best scores of other ranges, floor: what the
        k-th best has at least. Without a unit the first window is as wide as the floor asks."""
        m, length = len(self.sorted), float(np.linalg.norm(query))
        need, centre = int(np.ceil(THRESHOLD * m)), (query * (self.largest / length)) @ self.directions[:-1]

        def wide(score: float) -> float:
            """Half the width at which a vector of this score collides often enough."""
            return spread * math.sqrt(max(2 * self.largest**2 - 2 * self.largest * score / length, 0.0)) + 1e-6 * self.largest

        half, seen = wide(floor) if unit is None else unit * self.largest, np.zeros(len(self.ids), bool)
        ids, scores = [], []
        while True:
            new = np.flatnonzero((self._collisions(centre, half) >= need) & ~seen if half < WIDEST * self.largest else ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            if len(best) == k or floor > -math.inf:  # single precision sorts out what is below the k-th best by far more than it may err
                worst = max(floor, float(best.min()) if len(best) == k else floor) / (length * self.largest)
                new = new[self.rough[new] @ (query / length).astype(np.float32) >= worst - 1e-4]
            found = (self.vectors[new] * query).sum(axis=1)
            ids.append(self.ids[new])
            scores.append(found)
            best = np.concatenate((best, found))
            best = np.partition(best, -k)[-k:] if len(best) > k else best
            worst = max(floor, float(best.min())) if len(best) == k else floor
            wanted = wide(worst) if worst > -math.inf else math.inf
            if half >= wanted or seen.all():
                return np.concatenate(ids), np.concatenate(scores)
            half = min(half * GROWTH, wanted)


def ranges(ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray) -> list[Index]:
    """Indexes of the vectors by ranges of norms, longest first."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    falling, start, out = -norms[order], 0, []
    while start < len(order):
        end = max(start + 1, int(np.searchsorted(falling, falling[start] / RANGE, "right")))
        part = order[start:end]
        out.append(Index(ids[part], vectors[part], directions, float(-falling[start])))
        start = end
    return out


def best_of(indexes: list[Index], query: np.ndarray, own: int, k: int, unit: float | None, spread: float, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best found in all ranges that reach the floor; unit is that of norm 1."""
    ids, scores, length = np.empty(0, np.int64), np.empty(0), float(np.linalg.norm(query))
    for index in indexes:
        if length * index.largest * (1 + 1e-9) < (max(floor, scores[-1]) if len(scores) == k else floor):
            break  # no shorter vector can reach the k-th best
        more, theirs = index.search(query, own, k, unit, spread, scores, floor)
        ids, scores = np.concatenate((ids, more[theirs >= floor])), np.concatenate((scores, theirs[theirs >= floor]))
        best = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[best], scores[best]
    return ids, scores


def first_window(sample: np.ndarray, share: float) -> float:
    """Distance, by norm, within which a sampled vector has this share of its sample, or its nearest: a tenth have it nearer."""
    some = sample[:256]
    unit = lambda x: x / np.sqrt((x**2).sum(axis=1))[:, None]
    cosine = np.sort(unit(some) @ unit(sample).T, axis=1)[:, ::-1]
    at = min(int(share * len(sample)) + 1, len(sample) - 1)  # the first is the vector itself
    return float(np.quantile(np.sqrt(np.maximum(2 - 2 * cosine[:, at], 0.0)), 0.1)) or 1e-6


def _spread(m: int, sure: float = SURE) -> float:
    """Half a window's width, by distance, at which a vector collides on enough of m directions with probability `sure`."""
    need, low, high = int(np.ceil(THRESHOLD * m)), 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        enough = sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(need, m + 1))
        low, high = (p, high) if enough < sure else (low, p)
    return NormalDist().inv_cdf((1 + min(high, 1 - 1e-12)) / 2)


class Cells:
    """The dealing directions with their medians: vectors to cells, queries to the cells that their windows reach."""

    def __init__(self, directions: np.ndarray, sample: np.ndarray, largest: float) -> None:
        self.directions, self.largest = directions, largest
        self.medians = np.median(self._places(sample), axis=0)
        self.bits = 1 << np.arange(len(self.medians))
        sure = REACH ** (1 / max(1, len(self.medians)))
        self.spread = NormalDist().inv_cdf((1 + sure) / 2)

    def _places(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.sqrt((vectors**2).sum(axis=1))
        top = RANGE ** (np.floor(np.log(np.maximum(norms, 1e-300)) / math.log(RANGE) + 0.5) + 0.5)
        return _lifted(vectors / top[:, None], 1.0) @ self.directions

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return (self._places(vectors) > self.medians) @ self.bits

    def reached(self, query: np.ndarray, floor: float) -> np.ndarray:
        """Cells that may hold a vector which scores at least the floor."""
        length = float(np.linalg.norm(query))
        near = floor / (length * self.largest * RANGE) if floor > 0 else -1.0
        away = (query / length) @ self.directions[:-1] - self.medians
        cells = np.array([(away > 0) @ self.bits], np.int64)
        for bit in self.bits[np.abs(away) <= self.spread * math.sqrt(max(2 - 2 * near, 0.0)) + 1e-6]:
            cells = np.concatenate((cells, cells ^ bit))
        return cells


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, projections: int = PROJECTIONS, block: int = BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by `every`; a row is no candidate for its own vec_id. Ties go to the smaller
    vec_id. Vectors that are null, zero, of another length than most, or hold null or non-finite components, and
    rows without vec_id, take no part. Rows that repeat a vec_id are candidates each, but a query and a
    candidate count once per vec_id and score. Other columns are left out; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    usable = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & _finite(F.col("v")))
    usable = written(usable.distinct(), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = usable.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("v"), deterministic=True).alias("d"), F.max(norm).alias("largest")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("v") == facts.d)
    if projections > 255:
        raise ValueError("collisions are counted in one byte: 255 projections at most")
    halvings = max(0, math.ceil(math.log2(facts.n / block)))
    directions = np.random.default_rng(20).standard_normal((facts.d + 1, projections + halvings))
    directions, dealing = directions[:, :projections], directions[:, projections:]
    seen = np.array([r.v for r in hash_sample(usable, "vec_id", sample).collect()])
    spread = _spread(projections)
    unit = first_window(seen, k / min(block, facts.n)) * spread
    cells = Cells(dealing, seen, facts.largest)

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(v.to_numpy())) if len(v) else np.empty(0), dtype="int64")

    # A cell holds `block` vectors or fewer, more where the table is uneven: it has as many blocks as it needs.
    dealt = written(usable.withColumn("cell", cell_of("v")), "dealt")
    sizes = {r.cell: -(-r["count"] // block) for r in dealt.groupBy("cell").count().collect()}  # 2 * n / block rows at most
    firsts = dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist(), strict=True))
    numbers = F.broadcast(spark.createDataFrame([(c, firsts[c], sizes[c]) for c in sizes], "cell long, first long, blocks long"))  # one row a cell
    indexed = dealt.join(numbers, "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks"))).alias("b"), "vec_id", "v")

    def answers(both: pd.DataFrame, asks: np.ndarray, held: np.ndarray, home: bool) -> pd.DataFrame:
        ids, rows, out = both["vec_id"].to_numpy(np.int64), np.stack(both["v"].to_numpy()), []
        floors = np.full(len(ids), -math.inf) if home else both["floor"].to_numpy(np.float64)
        indexes = ranges(ids[held], rows[held], directions) if asks.any() and held.any() else []
        for own, query, floor in zip(ids[asks], rows[asks], floors[asks], strict=True):
            found, scores = best_of(indexes, query, own, k, unit if floor == -math.inf else None, spread, floor)
            out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def at_home(both: pd.DataFrame) -> pd.DataFrame:
        return answers(both, both["vec_id"].to_numpy(np.int64) % every == 0, np.ones(len(both), bool), True)

    def elsewhere(both: pd.DataFrame) -> pd.DataFrame:
        asks = both["asks"].to_numpy(bool)
        return answers(both, asks, ~asks, False)

    schema = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block
    best = written(indexed.groupBy("b").applyInPandas(at_home, schema), "home")
    if len(sizes) > 1 or max(sizes.values()) > 1:
        floors = best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        asking = indexed.where(F.col("vec_id") % every == 0).join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))

        @F.pandas_udf("array<long>")
        def reached(v: pd.Series, floor: pd.Series) -> pd.Series:
            return pd.Series([[b for c in cells.reached(np.asarray(q), f).tolist() if c in sizes for b in range(firsts[c], firsts[c] + sizes[c])] for q, f in zip(v, floor, strict=True)])

        asking = asking.select("vec_id", "v", "floor", F.col("b").alias("_home"), F.explode(reached("v", "floor")).alias("b")).where("b <> _home").drop("_home")
        asking = written(asking, "asking")
        parts = asking.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
        spread_out = indexed.join(parts, "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("floor"))
        asking = asking.join(parts, "b").select("b", F.pmod(F.xxhash64("v", "vec_id"), F.col("parts")).alias("p"), F.lit(True).alias("asks"), "vec_id", "v", "floor")
        best = best.union(spread_out.unionByName(asking).groupBy("b", "p").applyInPandas(elsewhere, schema))
    ranked = best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
