"""Near-duplicates by BagMinHash: weighted Jaccard of the bags of word shingles.

A document is the bag (multiset) of its runs of five words; documents are linked where
sum(min counts) / sum(max counts) >= 0.8.

Signature. Over each shingle stands a Poisson process in time, weight and register, one hit per unit
of time, weight and register on average. The weight axis is cut into the dyadic levels
[0,1), [1,2), [2,4), ...; a document whose count is w sees a level's hits below w only, so counts of any
size cost a few streams and not w of them. A register's value is the first hit that the document
sees; two documents agree in a register with a probability of exactly their weighted Jaccard
similarity. Streams are read up to a time by which every register is most likely filled, and further where
one is not.

Candidates are documents that agree in all `rows` registers of one of `bands` bands. With 24 bands of 4 a
pair at similarity 0.8 is missed with a probability of 3e-6. Every candidate is verified on the whole bags.

Equal bags are one node from the start, so copies are never paired. In each bucket the node whose buckets are
largest (most often what the others were made from) is the head, and all others are verified against it: linear
in the bucket. Components are formed. What may still be missing are links between two members x, y of
one head h that are in different components, so that one of them, say x, is not linked to h. Within h their overlap
is at most that of either with h; the rest must come from the shingles that both have beyond h. How many of those a link
needs follows from the sizes, and two sets with that many in common meet in the first few of their
elements, rarest first (prefix filter). Pairs that meet there, and pairs that need none, are all verified; no other pair can be
a link. Near copies seldom share what sets them apart from their head, so a large group of them does not give
its pairs. No step gathers a bucket in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .batches import parts
from .components import components
from .store import set_aside, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
GOLDEN = 0x9E3779B97F4A7C15
#: Pairs from which on a head's bag may be broadcast, and bytes of all such bags.
HOT, SENT = 500, 1 << 25
#: Hits per register that are read at first, beyond log(registers).
SLACK = 4.0


def bag(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts. A text of fewer words is one shingle, a blank text none."""
    words = H.words(text or "")
    return np.unique(H.windows(words, min(shingle, len(words)) or 1), return_counts=True)


def digest(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """128 bits that name the bag."""
    both = np.empty(2 * len(keys), np.uint64)
    both[0::2], both[1::2] = keys, counts
    return b"".join(H.windows(both, len(both), p).tobytes() for p in (H.IN_WINDOW, H.IN_WINDOW_2))


def _streams(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per shingle and dyadic level below its count: seed, lowest weight, width, count."""
    seeds, low, width, count = [keys], [np.zeros(len(keys), np.int64)], [np.ones(len(keys), np.int64)], [counts]
    level = 1
    while (more := counts > level).any():
        keys, counts = keys[more], counts[more]
        seeds.append(H.mix(keys ^ np.uint64(level * GOLDEN & (1 << 64) - 1)))
        low.append(np.full(len(keys), level))
        width.append(np.full(len(keys), level))
        count.append(counts)
        level *= 2
    return tuple(map(np.concatenate, (seeds, low, width, count)))


def signature(keys: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """The hit (32 bits of its name) that comes first in each register."""
    seed, low, width, count = _streams(keys, counts)
    until = (np.log(registers) + SLACK) / counts.sum()
    while True:
        best = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
        at, time, step = np.arange(len(seed)), np.zeros(len(seed)), 0
        chunk = int(np.ceil(registers * until)) + 1
        while len(at):
            numbers = np.arange(step + 1, step + chunk + 1, dtype=np.uint64) * np.uint64(GOLDEN)
            state = H.mix(seed[at][:, None] + numbers[None, :])
            gaps = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (registers * width[at])[:, None]
            times = time[at][:, None] + np.cumsum(gaps, axis=1)
            name = H.mix(state)
            weight = np.broadcast_to(low[at][:, None], name.shape).copy()
            wide = width[at] > 1  # a power of two
            weight[wide] += (H.mix(name[wide]) & (width[at][wide] - 1).astype(np.uint64)[:, None]).astype(np.int64)
            hit = (times <= until) & (weight < count[at][:, None])
            name, when = name[hit], times[hit]
            register = ((name >> np.uint64(32)) & np.uint64(0xFFF)) % np.uint64(registers)
            np.minimum.at(best, register.astype(np.int64), ((when / until * (2.0**32 - 1)).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF)))
            time[at] = times[:, -1]
            at = at[times[:, -1] <= until]
            step += chunk
        if (best != np.iinfo(np.uint64).max).all():
            return (best & np.uint64(0xFFFFFFFF)).astype(np.uint64)
        until *= 2


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band; keys of different bands differ."""
    parts = found[: bands * rows].reshape(bands, rows)
    key = H.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    for i in range(rows):
        key = H.mix(key + parts[:, i])
    return key.view(np.int64)


def _signed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            nodes, keys = [], []
            for text in batch.column("text").to_pylist():
                shingles, counts = bag(text, shingle)
                nodes.append(digest(shingles, counts) if len(shingles) else None)
                keys.append(band_keys(signature(shingles, counts, bands * rows), bands, rows) if len(shingles) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "version", "node", "buckets"])

    return run


def _bags(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys, counts = [], []
            for text in batch.column("text").to_pylist():
                k, n = bag(text, shingle)
                keys.append(k.tobytes())
                counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["node", "keys", "counts"])

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    (x, m), (y, n) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = y[at] == x
    both = int(np.minimum(m[common], n[at[common]]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def excess(x: tuple[np.ndarray, np.ndarray], h: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What x has beyond h: one element for each further occurrence of a shingle, the same for every x."""
    at = np.minimum(np.searchsorted(h[0], x[0]), len(h[0]) - 1)
    had = np.where(h[0][at] == x[0], h[1][at], 0)
    more = np.maximum(x[1] - had, 0)
    first = np.repeat(had - np.r_[0, np.cumsum(more)[:-1]], more)
    return H.mix(np.repeat(x[0], more) + (first + np.arange(more.sum())).astype(np.uint64) * np.uint64(GOLDEN))


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda k, n: (np.frombuffer(k, np.uint64), np.frombuffer(n, "<u4").astype(np.int64))
        for batch in parts(batches):
            columns = [batch.column(c).to_pylist() for c in ("keys_a", "counts_a", "keys_b", "counts_b")]
            linked, both, size, head, apart = [], [], [], [], []
            for k, m, x, n in zip(*columns, strict=True):
                a, b = of(k, m), of(x, n)
                beyond = excess(b, a)
                head.append(int(a[1].sum()))
                size.append(int(b[1].sum()))
                both.append(size[-1] - len(beyond))
                linked.append(both[-1] >= similarity * (head[-1] + size[-1] - both[-1]) - 1e-9)
                apart.append(beyond.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(head, pa.int64()), pa.array(size, pa.int64()), pa.array(both, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], ["a", "b", "linked", "head", "size", "both", "excess"])

    return run


def _whole_bags(asked: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, keys, counts) of the asked nodes, from the one row that stands for each: the only step that shuffles texts."""
    sources = nodes.join(asked, "node").select("node", F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").join(sources, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    return written(texts.select("node", "text").mapInArrow(_bags(shingle), "node binary, keys binary, counts binary").dropDuplicates(["node"]), "bags")


def _compared(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with what their whole bags say: linked, head and size (of a and b), both (their
    overlap), excess (what b has beyond a).

    The bag of a head with many pairs goes to the tasks once, as long as such bags are small enough together, and not once a pair.
    """
    side = lambda name: bags.select(F.col("node").alias(name), F.col("keys").alias(f"keys_{name}"), F.col("counts").alias(f"counts_{name}"))
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT, pairs.count() // 1000))  # a thousand at most
    sized = often.join(bags.select(F.col("node").alias("a"), (F.length("keys") + F.length("counts")).alias("size")), "a").select("a", "n", "size").collect()
    hot, total = [], 0
    for r in sorted(sized, key=lambda r: (-r.n, r.a)):
        if total + r.size <= SENT:
            hot.append((r.a,))
            total += r.size
    known = F.broadcast(pairs.sparkSession.createDataFrame(hot, "a binary"))
    cold = pairs.join(known, "a", "left_anti").join(side("a"), "a").join(side("b"), "b")
    warm = pairs.join(known, "a").join(side("b"), "b").join(F.broadcast(side("a").join(known, "a")), "a")  # `SENT` bytes at most
    pairs = cold.unionByName(warm) if hot else cold
    return written(pairs.mapInArrow(_verified(similarity), "a binary, b binary, linked boolean, head long, size long, both long, excess array<long>"), "compared")


def _unheaded(compared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of one head that are in different components and may be linked all the same."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    known = compared.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns({f"root_{s}": F.coalesce(f"root_{s}", s) for s in "ab"})
    heads = known.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.min("root_b").alias("_low"), F.max("root_b").alias("_high")).where("_n > 1 and _low < _high").select("a")
    known = written(known.join(heads, "a").select("a", "b", "head", "size", "both", "excess", "root_b", (F.col("root_a") != F.col("root_b")).alias("loose")), "members")

    # The elements of each member, rarest in its head's group first. As sizes of a link differ by `similarity` at most, a member's
    # own numbers bound how many of them a link needs, hence which of its elements can be the first common one.
    least = F.greatest(F.ceil(similarity * F.col("size") - F.col("both") - 1e-6), F.lit(1))
    spread = known.select("a", "b", F.explode("excess").alias("element"))
    often = spread.groupBy("a", "element").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("a", "b").orderBy("often", "element")  # one document's elements
    ranked = spread.join(often, ["a", "element"]).withColumn("rank", F.row_number().over(order)).where("often > 1")
    own = known.select("a", "b", "size", "both", F.size("excess").alias("own"), "root_b", "loose", least.alias("_least"))
    ranked = written(ranked.join(own, ["a", "b"]).where(F.col("rank") <= F.col("own") - F.col("_least") + 1).drop("_least"), "ranked")

    side = lambda df, name: df.select("a", *(c for c in ("element", "_step") if c in df.columns), *(F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in ("a", "element", "_step")))
    needs = F.ceil(similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - F.least("both_x", "both_y") - 1e-6)
    meets = (F.col("rank_x") <= F.col("own_x") - needs + 1) & (F.col("rank_y") <= F.col("own_y") - needs + 1)
    apart = F.col("root_b_x") != F.col("root_b_y")
    alike = side(ranked.where("loose"), "x").join(side(ranked, "y"), ["a", "element"]).where(apart & meets)
    # Without a common element beyond the head: x is not linked to the head, so that y must be shorter than it. Both lie in the head
    # almost whole, and their sizes are of one step or of neighbouring ones.
    step = F.floor(F.log(F.col("size").cast("double")) / -math.log(similarity))
    bare = known.where(F.col("both") >= similarity * F.col("size") - 1e-6).select("a", "b", "head", "size", "both", "root_b", "loose", step.alias("_step"))
    near = bare.where("size < head").withColumn("_step", F.explode(F.array(F.col("_step") - 1, F.col("_step"), F.col("_step") + 1)))
    short = side(bare.where("loose"), "x").join(side(near, "y"), ["a", "_step"]).where(apart & (needs <= 0))
    pair = F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")
    return alike.select(*pair).union(short.select(*pair)).distinct()


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, version (a hash of the text) and class_id, the least doc_id of its class.

    A class is a connected component of the links. A text without words (null, empty, blank) has no
    shingles and is a class of its own (class_id is its doc_id). A null doc_id gets its class's least doc_id, null if
    there is none. Equal rows, and rows that share a doc_id, are told apart by their text alone. Other columns are
    left out; an empty table gives an empty one. Memory is a multiple of one text.
    """
    source = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = written(source.mapInArrow(_signed(shingle, bands, rows), f"doc_id {kind}, version long, node binary, buckets array<long>"), "signatures")

    named, one = signed.where("node is not null").groupBy("node"), F.struct("doc_id", "version")  # a row with an id, if there is one
    nodes = written(named.agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), one)), F.min(one)).alias("_first"), F.min("doc_id").alias("least"), F.first("buckets").alias("buckets")), "nodes")
    nodes = nodes.select("node", "least", "buckets", "_first.doc_id", "_first.version")
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(placed.join(sizes, "bucket"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = shared.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("_top")).select("bucket", F.col("_top.node").alias("head"))
    members = shared.join(heads, "bucket").where("node <> head")

    pairs = written(members.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    bags = _whole_bags(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, shingle)
    compared = _compared(pairs, bags, similarity)
    links = compared.where("linked").select("a", "b")
    roots = components(links)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(_unheaded(compared, roots, similarity).join(tested, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = components(links.union(_compared(rest, bags, similarity).where("linked").select("a", "b")))

    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id")
    return signed.select("doc_id", "version", "node").join(classes, "node", "left").select("doc_id", "version", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Rows without words stay, all of them.

    Of rows equal in doc_id and text the one whose other columns have the least hash stays. All columns are kept, whatever
    their names; a class without any doc_id keeps one row a text.
    """
    plain, back = set_aside(docs)
    classes = near_duplicate_classes(plain.select("doc_id", "text"), shingle, similarity)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "version").distinct()
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    others = [c for c in plain.columns if c.startswith("_own_")]
    rows = plain.where(worded).withColumns({"_version": F.xxhash64("text"), "_rest": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")})
    kept = kept.join(rows.groupBy(F.col("doc_id").alias("_id"), "_version").agg(F.min("_rest").alias("_least")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    kept = kept.select("_id", F.col("_version").alias("_kept"), "_least")
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_kept")) & (F.col("_rest") == F.col("_least")), "left_semi")
    return back(rows.dropDuplicates(["doc_id", "_version"]).unionByName(plain.where(~worded), allowMissingColumns=True))
