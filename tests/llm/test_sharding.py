import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import sharding as S

SCHEMA = "doc_id long, text string, size string, shard int"


@pytest.mark.parametrize("seed", range(20))
def test_plan_fills_every_shard_without_gaps(seed):
    rng = np.random.default_rng(seed)
    shards = int(rng.integers(1, 9))
    _, owner = S.ring_points(shards, 16)
    counts = rng.integers(0, 12, len(owner)) * (rng.random(len(owner)) < 0.6)
    counts[int(rng.integers(len(owner)))] += int(rng.integers(0, 300))  # a hot arc
    capacity = S.capacities(int(counts.sum()), shards, 0.0)
    plan = S.plan_ring(counts, owner, capacity)
    by_arc, by_shard = {}, {}
    for arc, start, end, shard, slot in plan:
        by_arc.setdefault(arc, []).append((start, end))
        by_shard.setdefault(shard, []).append((slot, slot + end - start))
    for arc, n in enumerate(counts):
        at = 0
        for start, end in sorted(by_arc.get(arc, [])):
            assert start == at
            at = end
        assert at == n
    for shard in range(shards):
        at = 0
        for start, end in sorted(by_shard.get(shard, [])):
            assert start == at
            at = end
        assert at == capacity[shard]


def test_rows_with_room_stay_at_home():
    _, owner = S.ring_points(8, 64)
    counts = np.full(len(owner), 10)
    load = np.bincount(owner, weights=counts)
    plan = S.plan_ring(counts, owner, S.capacities(int(counts.sum()), 8, 0.05))
    moved = sum(end - start for arc, start, end, shard, _ in plan if owner[arc] != shard)
    over = np.maximum(load - np.ceil(1.05 * counts.sum() / 8), 0).sum()
    assert moved == over


def test_adding_a_shard_moves_little():
    keys = np.arange(20000)
    place = np.array([int.from_bytes(zlib.crc32(str(k).encode()).to_bytes(4, "big") * 2, "big", signed=True) for k in keys])
    homes = []
    for shards in (8, 9):
        points, owner = S.ring_points(shards, 256)
        homes.append(owner[np.searchsorted(points, place) % len(points)])
    changed = homes[0] != homes[1]
    assert (homes[1][changed] == 8).all() and changed.mean() < 0.2


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, "x", 1) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, None, "x", 1)] * 40 + [(5000, "", "x", 1), (rows[0][0], rows[0][1], "x", 1), (rows[0][0], "other", "x", 1), (6000, "é" * 100000, "x", 1)]
    got = S.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    wanted = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for shard, n in per.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    again = S.shard_documents(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert S.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_key_and_no_key_on_most_rows(spark):
    rows = [(7, i, i) for i in range(600)] + [(None, i, i) for i in range(600)] + [(i, 1, 1) for i in range(100, 200)] + [(7, 3, 3)] * 5
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long")
    out = S.shard_rows(df, "doc_id", ["size", "text_crc32"], 8, 64).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((a or -1, b, c) for a, b, c in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    again = S.shard_rows(df.repartition(7), "doc_id", ["size", "text_crc32"], 8, 64).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    # Without a bound, rows without a key spread over the shards and those of one key stay together.
    free = S.shard_rows(df, "doc_id", ["size", "text_crc32"], 8, 64, epsilon=8.0).collect()
    assert len({r.shard for r in free if r.doc_id is None}) == 8 and len({r.shard for r in free if r.doc_id == 7}) == 1
