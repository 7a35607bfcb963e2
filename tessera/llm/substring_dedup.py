"""Removal of passages that another document already has, behind a count-min prefilter.

A window is `width` consecutive words of one document. Each word covered by a window whose word
sequence also starts in a document with a smaller doc_id is removed.

Windows are counted by their anchor: the least hash among the runs of width // 2 words inside
the window. Equal windows have equal anchors, so an anchor's count is never below that of its
windows, and neighbouring windows mostly share one: there is about one anchor for every
thirteen windows.

1. Count-min pass. Each partition counts its anchors (once a document) in a sketch of `DEPTH`
   rows; the partition sketches are merged by segment, and one bit a cell, "counted twice or
   more", comes back. Estimates are too high or exact, never too low, so no repeated window is
   lost. The sketch is sized from the texts' bytes, so that it sorts out as large a share of the anchors in a large
   table as in a small one. Where that is more than `most_cells`, anchors are dealt to rounds by
   their hash: each round has a sketch of that size for its own anchors, and reads the texts again.
2. Exact pass, over the runs of windows whose anchor is estimated repeated. A run is the
   consecutive windows of one document with one anchor, keyed by anchor and the hash of its
   windows. Copies of a run after its first document are removed whole. Where an anchor
   stands over several different runs, the first of each is opened and its windows are
   grouped one by one. Keys hold 128 bits.

Nothing is collected by group: both groupings are minima with map-side combination, so a
passage in a third of all documents costs one row a task. In the joins back, keys that hold more than a
thousandth of all rows, a thousand keys at most, are broadcast; the rest are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts
from .store import set_aside, written

WIDTH = 50
DEPTH = 3
#: Cells of a row: one for so many bytes of text (three for each two anchors or more), between these bounds.
BYTES_A_CELL, LEAST_CELLS, MOST_CELLS = 48, 1 << 20, 1 << 29
SEGMENT = 1 << 16
#: Keys with more than one row of so many are hot.
HOT = 1000
#: Anchors that a task holds before it passes its sketch on.
FLUSH = 1 << 21


def anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window, in order."""
    inner = max(1, width // 2)
    return H.sliding_min(H.windows(words, inner), width - inner + 1) if len(words) >= width else np.empty(0, np.uint64)


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of each key in one row of the sketch."""
    return H.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(cells - 1)


def round_of(keys: np.ndarray, rounds: int) -> np.ndarray:
    """The round of each key."""
    return H.mix(keys) % np.uint64(rounds)


def _partial_sketches(width: int, cells: int, depth: int, turn: int, rounds: int):
    """Texts to sparse sketches: per row and segment, the places counted once and those counted more often."""

    def sketch(keys: list[np.ndarray]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        joined = np.concatenate(keys)
        for row in range(depth):
            cell, count = np.unique(cells_of(joined, row, cells), return_counts=True)
            segment, place = (cell // np.uint64(SEGMENT)).astype(np.int32), (cell % np.uint64(SEGMENT)).astype("<u2")
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for s, p, n in zip(segment[np.r_[0, cuts]], np.split(place, cuts), np.split(count, cuts), strict=True):
                for column, value in zip(out, (row, int(s), p[n == 1].tobytes(), p[n > 1].tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["row", "segment", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(anchors(H.words(text.as_py() or ""), width))
                found = found[round_of(found, rounds) == turn] if rounds > 1 else found
                if len(found):
                    held.append(found)
                    n += len(found)
                if n >= FLUSH:
                    yield sketch(held)
                    held, n = [], 0
        if held:
            yield sketch(held)

    return run


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketches segment by segment; a segment's counters are kept at 2 at most."""
    counters: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, segment, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counter = counters.setdefault((row, segment), np.zeros(SEGMENT, np.uint8))
            once = np.frombuffer(once, "<u2")  # places are distinct within one sketch
            counter[once] = np.minimum(counter[once] + 1, 2)
            counter[np.frombuffer(more, "<u2")] = 2
    for (row, segment), counter in counters.items():
        bits = np.packbits(counter > 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([segment], pa.int32()), pa.array([bits], pa.binary())], ["row", "segment", "bits"])


def sketch_size(docs: DataFrame, most_cells: int = MOST_CELLS) -> tuple[int, int]:
    """(cells of a row, rounds) for the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(LEAST_CELLS, 1 << max(0, size // BYTES_A_CELL - 1).bit_length())
    return min(wanted, most_cells), max(1, wanted // most_cells)


def repeated_cells(docs: DataFrame, width: int, cells: int, depth: int = DEPTH, turn: int = 0, rounds: int = 1) -> np.ndarray:
    """The merged sketch of one round as bits (depth, cells / 8): cells that are counted twice or more."""
    partial = docs.select("text").mapInArrow(_partial_sketches(width, cells, depth, turn, rounds), "row int, segment int, once binary, more binary")
    merged = partial.repartition("row", "segment").mapInArrow(_merge_sketches, "row int, segment int, bits binary")
    bits = np.zeros((depth, cells // 8), np.uint8)
    for row, segment, part in merged.collect():  # depth * cells / 8 bytes in all
        bits[row, segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(part, np.uint8)
    return bits


def estimated_repeated(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the sketch puts each key's count at two or more."""
    out = np.ones(len(keys), bool)
    for row in range(len(bits)):
        cell = cells_of(keys, row, bits.shape[1] * 8)
        out &= bits[row, cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & 1 == 1
    return out


def _runs(width: int, bits, turn: int, rounds: int):
    """(doc_id, version, text) to the runs whose anchor is estimated repeated; equal runs of a document are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = bits.value
        for batch in parts(batches):
            held: list[list[np.ndarray]] = [[] for _ in range(8)]
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = H.words(text or "")
                anchor = anchors(words, width)
                if not len(anchor) or doc_id is None:
                    continue
                starts = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]
                sizes = np.diff(np.r_[starts, len(anchor)])
                keep = estimated_repeated(anchor[starts], sketch)
                keep &= (round_of(anchor[starts], rounds) == turn) if rounds > 1 else True
                if not keep.any():
                    continue
                window = H.windows(words, width)
                up, down = H.IN_WINDOW_2.upto(len(window) + 1)
                sums = np.zeros(len(window) + 1, np.uint64)
                np.cumsum(window * up[: len(window)], out=sums[1:])
                starts, sizes = starts[keep], sizes[keep]
                content = H.mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
                _, first, which = np.unique(np.stack((anchor[starts], content)), axis=1, return_index=True, return_inverse=True)
                which = which.ravel()
                own, size = starts[first], sizes[first]
                inside = np.repeat(own - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                same = np.full(len(first), doc_id, np.int64), np.full(len(first), version, np.int64)
                places = starts[np.argsort(which, kind="stable")].astype(np.int32)
                for column, values in zip(held, (*same, anchor[own].view(np.int64), content[first].view(np.int64), size.astype(np.int32), places, np.bincount(which), window[inside]), strict=True):
                    column.append(values)
            if held[0]:
                *columns, places, times, window = (np.concatenate(h) for h in held)
                ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                starts = pa.ListArray.from_arrays(ends(times), pa.array(places))
                windows = pa.Array.from_buffers(pa.binary(), len(times), [None, ends(columns[4].astype(np.int64) * 8).buffers()[1], pa.py_buffer(window.tobytes())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), starts, windows], ["doc_id", "version", "anchor", "content", "n", "starts", "windows"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to single windows; `at` is a window's place in its run."""
    for batch in parts(batches):
        n = np.asarray(batch.column("n"))
        window = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.int64)
        at = np.arange(n.sum(), dtype=np.int32) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        kept = batch.select(["doc_id", "version", "anchor", "content"]).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at.astype(np.int32)), pa.array(window)], ["doc_id", "version", "anchor", "content", "at", "window"])


def joined_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows join facts, one row a key, on keys. Facts whose `count` of rows is more than a thousandth of the table (hence a
    thousand at most) are broadcast, so that no task gets all rows of a hot key. Both tables are read more than once: written ones."""
    hot = F.col(count) * HOT > rows.count()
    few = F.broadcast(facts.where(hot).drop(count))
    rest = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(facts.where(~hot).drop(count), keys))


def repeated_ranges(docs: DataFrame, width: int = WIDTH, most_cells: int = MOST_CELLS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, version, n, start): n windows from word `start` on that a smaller doc_id has too.

    version is a hash of the text; it keeps rows apart that share a doc_id.
    """
    spark = docs.sparkSession
    cells, rounds = sketch_size(docs, most_cells)
    source = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    runs = None
    for turn in range(rounds):
        bits = spark.sparkContext.broadcast(repeated_cells(docs, width, cells, depth, turn, rounds))
        found = written(source.mapInArrow(_runs(width, bits, turn, rounds), "doc_id long, version long, anchor long, content long, n int, starts array<int>, windows binary"), "runs")
        runs = found if runs is None else runs.unionByName(found)
        bits.unpersist()

    first = runs.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("_rows"))
    first = written(first, "first-runs")
    several = first.groupBy("anchor").agg(F.min("first").alias("_min"), F.max("last").alias("_max"), F.count(F.lit(1)).alias("_runs"))
    several = written(several.where((F.col("_runs") > 1) & (F.col("_min") < F.col("_max"))).select("anchor", "_runs"), "several")

    later = joined_hot(runs.drop("windows"), first.where("first < last").select("anchor", "content", "first", "_rows"), ["anchor", "content"], "_rows").where("doc_id > first")
    later = later.select("doc_id", "version", "n", F.explode("starts").alias("start"))
    opening = joined_hot(first.select("anchor", "content", F.col("first").alias("doc_id")), several, ["anchor"], "_runs")
    heads = runs.join(opening, ["anchor", "content", "doc_id"])
    heads = written(heads.select("doc_id", "version", "anchor", "content", "n", "starts", "windows"), "heads")
    opened = written(heads.drop("starts").mapInArrow(_opened, "doc_id long, version long, anchor long, content long, at int, window long"), "windows")
    least = opened.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("_rows"))
    least = written(least.where("first < last").drop("last"), "least")
    single = joined_hot(opened, least, ["anchor", "window"], "_rows").where("doc_id > first").select("doc_id", "version", "anchor", "content", "at")
    single = single.join(heads.select("doc_id", "version", "anchor", "content", "starts"), ["doc_id", "version", "anchor", "content"])
    single = single.select("doc_id", "version", F.lit(1).alias("n"), F.explode(F.transform("starts", lambda s: s + F.col("at"))).alias("start"))
    return later.unionByName(single)


def _kept(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[list] = [[], [], []]
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if ranges:
                    change = np.zeros(n + 1, np.int64)
                    for x in ranges:
                        change[x["start"]] += 1
                        change[x["start"] + x["n"] + width - 1] -= 1
                    words = [w for w, gone in zip(words, np.cumsum(change[:-1]) > 0, strict=True) if not gone]
                kept = b" ".join(words)
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append((text if n == len(words) else kept.decode()) if with_text else hashlib.sha256(kept).hexdigest())
            own = [c for c in batch.schema.names if c not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                [*own, "n_words", "n_removed", "text" if with_text else "kept_sha256"],
            )

    return run


def _joined(docs: DataFrame, width: int, most_cells: int, depth: int) -> DataFrame:
    ranges = repeated_ranges(docs, width, most_cells, depth).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return docs.withColumn("version", F.xxhash64("text")).join(ranges, ["doc_id", "version"], "left")


def dedup_report(docs: DataFrame, width: int = WIDTH, most_cells: int = MOST_CELLS, depth: int = DEPTH) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept words joined by a space.

    Null and empty texts have no words and the digest of nothing. A null doc_id is neither smaller nor
    larger than any other: such rows lose nothing and cost others nothing. Rows that share a doc_id don't
    remove one another's words; equal rows give equal results. Other columns are left out; an empty table
    gives an empty one. Texts may be of any length; memory is a small multiple of one text.
    """
    rows = _joined(docs.select("doc_id", "text"), width, most_cells, depth).select("doc_id", "text", "ranges")
    return rows.mapInArrow(_kept(width, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = WIDTH, most_cells: int = MOST_CELLS, depth: int = DEPTH) -> DataFrame:
    """docs with the removed words taken out of `text`; a text that loses nothing stays as it is.

    A text that loses words is its kept words joined by a space. Rows are never dropped; other columns are kept.
    """
    rows, back = set_aside(docs)
    rows = _joined(rows, width, most_cells, depth).drop("version")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in ("text", "ranges")}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", n_words long, n_removed long, text string"
    return back(rows.mapInArrow(_kept(width, True), schema))


def dedup_sql(width: int = WIDTH) -> str:
    """dedup_report for DuckDB, by comparing whole windows."""
    return rf"""
    WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM split),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS h FROM starts),
    first AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS pos FROM windows JOIN first USING (h) WHERE doc_id > first),
    spots AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words FROM spots ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)"""
