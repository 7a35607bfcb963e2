"""Best-fit packing of tokenised documents, improved by swaps.

A document's ids end with an end id. Only a document longer than a sequence is cut: into pieces of a
whole sequence, the first of which may be shorter. Pieces that fit are packed by length alone, so
the whole problem is one count per length: `capacity` numbers, whatever the input. On those the driver
fills bins best fit, longest first, whole groups of equal bins at a time, and then
improves the underfull ones by local search: it moves a document, exchanges one for one or one for two,
always from an emptier bin to a fuller one. Each step raises the sum of squared fills; a bin whose last
document goes is saved.

Pieces are numbered within their length by the task that made them plus a prefix sum over
tasks, so that a length which a third of all pieces share costs no sort and no large group. Each finds
its sequence by binary search in the plan's rank ranges.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import parts
from .store import written
from .tokens import RANKS, VOCABULARY, encoder

CAPACITY = 1024
END = 2
#: Ranks within a length are below this.
SPAN = 1 << 50

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Bins by pattern (lengths, longest first) with their number: best fit, longest length first."""
    free: dict[int, list[list]] = defaultdict(list)  # gap to [pattern, bins]
    for length in sorted(counts, reverse=True):
        left, gap = counts[length], length
        while left:
            while gap <= capacity and not free[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                for size, bins in ((each, left // each), (left % each, 1)):
                    if size and bins:
                        free[capacity - size * length].append([(length,) * size, bins])
                break
            group = free[gap][-1]
            n = min(group[1], left)
            free[gap - length].append([(*group[0], length), n])
            group[1] -= n
            left -= n
            if not group[1]:
                free[gap].remove(group)
            gap = length if gap - length >= length else gap
    bins: Counter = Counter()
    for groups in free.values():
        for pattern, n in groups:
            bins[pattern] += n
    return bins


def _swapped(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted((*left, *into), reverse=True))


def _best_move(donor: Pattern, bins: Counter, index: dict[int, tuple[list[int], list[Pattern]]], backs: list[int], capacity: int) -> tuple | None:
    """(tokens gained, target, taken from the donor, given back) of the move that fills a fuller bin most."""
    fill, best = sum(donor), (0, None, (), ())
    kinds = Counter(donor)  # pairs of lengths, not of pieces: a bin holds few different lengths
    offers = [(x,) for x in kinds] + [p for p in combinations_with_replacement(kinds, 2) if p[0] != p[1] or kinds[p[0]] > 1]
    for offer in offers:
        size = sum(offer)
        for back in backs:  # 0: nothing comes back; gains fall
            gain = size - back
            if gain <= best[0]:
                break
            if not back and len(offer) > 1:
                continue
            gaps, patterns = index[back]
            for at in range(bisect.bisect_left(gaps, gain), len(gaps)):
                target = patterns[at]
                if capacity - gaps[at] + gain <= fill:
                    break  # the rest is emptier still
                if bins[target] > (target == donor):
                    best = (gain, target, offer, (back,) if back else ())
                    break
    return best if best[1] else None


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search on the underfull bins until a sweep finds no move. Each move raises the sum of squared fills, so it ends."""
    bins, moved = Counter(bins), True
    while moved:
        open_bins = sorted((p for p, n in bins.items() if n and sum(p) < capacity), key=lambda p: (sum(p), p))
        by_item: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
        for pattern in open_bins:
            for item in (0, *set(pattern)):
                by_item[item].append((capacity - sum(pattern), pattern))
        index = {item: tuple(map(list, zip(*sorted(found), strict=True))) for item, found in by_item.items()}
        backs, moved = sorted(index), False
        for donor in open_bins:
            while bins[donor] and (move := _best_move(donor, bins, index, backs, capacity)):
                _, target, offer, back = move
                n = bins[donor] // 2 if target == donor else min(bins[donor], bins[target])
                for pattern, change in ((donor, -n), (target, -n), (_swapped(target, back, offer), n), (_swapped(donor, offer, back), n)):
                    bins[pattern] += change
                moved = True
        bins = Counter({p: n for p, n in bins.items() if n and p})
    return bins


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset): ranks of a length to places.

    Rank r goes to sequence `first sequence + r - first rank`. Sorted by length and rank.
    """
    bins = improve(best_fit(counts, capacity), capacity)
    used, sequence, rows = Counter(), 0, []
    for pattern in sorted(bins, reverse=True):
        n, offset = bins[pattern], 0
        for length in pattern:
            rows.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def _pieces(capacity: int, vocabulary: str, ranks: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), Counter()
        end = np.array([END], "<u4")
        for batch in parts(batches):
            source, rows, ids_of = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate((encode(text or ""), end))
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    source.append(i)
                    rows.append((piece, start, length, zlib.crc32(part.tobytes()), task, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            arrays = [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:4]), pa.array(columns[4], pa.int32()), pa.array(columns[5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seen"]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    A null text counts as empty and gives the end id alone. Equal rows, and rows that share a doc_id or have
    none, are packed each for itself. Other columns are left out; an empty table gives an empty one.
    A text's ids are held by one task at a time; everything else that is held is bounded by `capacity`.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, seen long" + (", ids array<int>" if with_ids else "")
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(capacity, vocabulary, ranks, with_ids), schema), "pieces")

    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = by_task.select("length", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {length: n for length, n in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    plan = spark.sparkContext.broadcast(plan_packing(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = plan.value
        at = np.searchsorted(rows[:, 0] * SPAN + rows[:, 1], length.to_numpy() * SPAN + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 4]})

    placed = pieces.join(offsets, ["length", "task"]).withColumn("_at", place("length", F.col("seen") + F.col("_before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", *(["ids"] if with_ids else []))


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and doc_ids and offsets of the pieces in order."""
    parts = pack_documents(docs, capacity, vocabulary, ranks, with_ids=True)
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_parts"))  # `capacity` pieces at most
    return rows.select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.doc_id").alias("doc_ids"), F.col("_parts.offset").alias("offsets"))
