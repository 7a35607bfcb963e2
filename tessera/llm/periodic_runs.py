"""Periodic runs of words by the Main-Lorentz divide and conquer.

A run is a maximal stretch of words with a smallest period q (words q apart are identical) and a length of at least
max(`least`, `times` * q). A text's words are interned to small numbers. A segment is halved; runs that cross the middle are
found from four Z-functions, for all periods at once: how far the words right of the middle repeat at distance q going on
and going back, and likewise those left of it. The halves are treated in the same way. A run lies wholly
in the largest segment whose middle it crosses, and is found there in full; smaller segments only see pieces of it, which go on
beyond their ends and are left out by looking at the next word. Multiples of a period give the same interval: of those the
smallest period stays.

A run repeats its words at distance q over length - q places, at least `least` - `least` / `times` of them. So a segment where no window of that
many words has an equal one at a distance of at most a `times`-th of the segment holds no run, and its Z-functions are left out.
That loses nothing, whatever the windows' hashes. In a text without repeated windows nothing but the windows is looked at.

Texts are independent: one pass over the table without a shuffle, in memory of a multiple of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts

LEAST, TIMES = 24, 3
SPACE = r"[\x20\x09-\x0D]+"
Run = tuple[int, int, int]


def z_function(x: list[int]) -> list[int]:
    """Per place, how many words from there on equal those from the start; 0 at the start itself."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(x: list[int], lo: int, hi: int, least: int, times: int) -> list[Run]:
    """(start, length, period) of the runs of x that lie in [lo, hi) and cross its middle; the smallest period first."""
    mid = (lo + hi) // 2
    u, v = x[lo:mid], x[mid:hi]
    back = u[::-1]
    top = (hi - lo) // times
    periods = np.arange(1, top + 1)

    def taken(z: list[int], at: np.ndarray) -> np.ndarray:
        """z at these places; 0 at places that the string doesn't have."""
        z = np.array([*z, 0])
        return z[np.where((at >= 0) & (at < len(z) - 1), at, len(z) - 1)]

    # Pairs of equal words at distance q: from the middle on, before the middle, and across it from either side.
    after = taken(z_function(v), periods)
    before = taken(z_function(back), periods)
    down = np.where(periods <= len(v), taken(z_function([*back, -1, *v[::-1]]), len(u) + 1 + len(v) - periods), 0)
    up = np.where(periods <= len(u), taken(z_function([*v, -1, *u]), len(v) + 1 + len(u) - periods), 0)
    whole = (down >= periods) & (up >= periods)
    found: dict[tuple[int, int], int] = {}
    for starts, ends, real in (
        (mid - periods - before, mid + periods + after, whole),
        (mid - down, mid + periods + after, ~whole & (down > 0)),
        (mid - periods - before, mid + up, ~whole & (up > 0)),
    ):
        for k in np.flatnonzero(real & (ends - starts >= np.maximum(least, times * periods))):
            s, e, q = int(starts[k]), int(ends[k]), int(periods[k])
            if (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q]):
                found[s, e] = min(q, found.get((s, e), q))
    return [(s, e - s, q) for (s, e), q in found.items()]


def near_repeats(x: list[int], width: int) -> np.ndarray:
    """Per window of `width` words, the distance to the one before that is equal (in its hash); a large number if there is none."""
    hashes = H.windows(H.mix(np.array(x, np.uint64) + np.uint64(1)), width)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.full(len(hashes), np.iinfo(np.int64).max)
    out[order[1:][same]] = order[1:][same] - order[:-1][same]
    return out


def runs(x: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs (start, length, period) of x, by start, then period."""
    if len(x) < least:
        return []
    width = least - least // times
    gap = near_repeats(x, width)
    found: list[Run] = []
    open_ = [(0, len(x))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < least or not (gap[lo : hi - width + 1] <= (hi - lo) // times).any():
            continue
        found += crossing(x, lo, hi, least, times)
        mid = (lo + hi) // 2
        open_ += [(lo, mid), (mid, hi)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _scanned(least: int, times: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            counts, every, best, texts = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                number: dict[bytes, int] = {}
                found = runs([number.setdefault(w, len(number)) for w in words], least, times)
                if found:
                    words_kept = kept_words(len(words), found)
                    words = [w for w, stays in zip(words, words_kept, strict=True) if stays]
                    counts.append(len(words_kept))
                else:
                    counts.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                top = strongest(found)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(every, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), best (the run of greatest length / period, or
    null) and collapsed: the words joined by single spaces, without those that a run only repeats.

    Null, empty and blank texts have no words and no runs. Rows are treated one by one, repeated or not, with any doc_id. Other
    columns are left out; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start:long,length:long,period:long>"
    return docs.select("doc_id", "text").mapInArrow(_scanned(least, times), f"doc_id {kind}, n_words long, runs array<{run}>, best {run}, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by the checksum of doc_id, the words from some place on repeat those at that place.

    With h = crc32(decimal doc_id) and g = h // 10: where h % 10 = 0 and there are n > 0 words, word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + (n - a) // (3 + g % 8). Texts without change stay as they are, and so do those of a null doc_id.
    """
    number = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), "")
    drawn = number % 10 == 0
    out = docs.select("doc_id", "text", drawn.alias("_drawn"), F.floor(number / 10).alias("_g"), F.when(drawn, words).alias("_words"))
    n = F.size("_words")
    out = out.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    longer = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(tail, times)))
    changed = F.array_join(F.slice(longer, F.lit(1), n), " ")
    return out.select("doc_id", F.when(F.col("_drawn") & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """periodic_runs() as numbers and digests, one row a document."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
