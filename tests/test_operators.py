import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import models, paths, times
from tessera.operators import clusters, curation, matching, scopes, snapshots, tables, trees
from tessera.sources import files
from tessera.streaming import tracks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("key", "name", "parent", "suffix", "trimmed"),
    [
        ("nas:/a/b.JPG", "b.JPG", "nas:/a", ".jpg", "nas:/a/b.JPG"),
        ("pc-x:D:\\p\\a.tar.gz", "a.tar.gz", "pc-x:D:\\p", ".gz", "pc-x:D:\\p\\a.tar.gz"),
        ("pc-x:D:", "D:\\", "pc-x:D:\\", "", "pc-x:D:\\"),
        ("nas:/", "/", "nas:/", "", "nas:/"),
        ("/a/b//", "b", "/a", "", "/a/b"),
        ("nas:/a/.hidden", ".hidden", "nas:/a", "", "nas:/a/.hidden"),
        ("\\\\host\\share\\x", "x", "\\\\host\\share\\", "", "\\\\host\\share\\x"),
    ],
)
def test_paths(spark, key, name, parent, suffix, trimmed):
    k = F.lit(key)
    row = spark.range(1).select(paths.name(k).alias("n"), paths.parent(k).alias("p"), paths.suffix(k).alias("s"), paths.trimmed(k).alias("t")).first()
    assert (row.n, row.p, row.s, row.t) == (name, parent, suffix, trimmed)


def test_chain(spark):
    assert one(spark, paths.chain(F.lit("pc-x:D:\\p\\q"))) == ["pc-x:D:\\", "pc-x:D:\\p", "pc-x:D:\\p\\q"]
    assert one(spark, paths.chain(F.lit("a/b"))) == ["a", "a/b"]


def test_rules(spark):
    keys = ["pc-x:D:\\Games\\a.jpg", "nas:/Games/a", "pc-x:D:\\trash\\Apps\\b", "pc-y:D:\\trash\\Apps\\b", "pc-x:D:\\Games\\keep\\c.jpg", "nas:/x.jpg"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.b for r in df.select("k", paths.blocked(F.col("k"), ["D:\\Games", "pc-x:D:\\trash\\Apps", "*.JPG"], ["d:/games/keep", "/x.jpg"]).alias("b")).collect()}
    assert [got[k] for k in keys] == [True, False, True, False, False, False]


def test_times(spark):
    now = times.F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    cases = {"IMG_20191218_131104": ("2019-12-18 13:11:04", "filename"), "WhatsApp Image 2021-12-27 at 18.16.46": ("2021-12-27 18:16:46", "filename"), "Photo 2021-12-27 В 18.16.46": ("2021-12-27 18:16:46", "filename"), "1573130586733": ("2019-11-07 12:43:06.733", "epoch-name"), "IMG-20180525-WA0008_1572848274767": ("2018-05-25 12:00:00", "filename-date"), "nothing": None, "20401231": None}
    for stem, wanted in cases.items():
        got = one(spark, times.time_from_name(F.lit(stem), now))
        assert (got and (got.at, got.how)) == (wanted and (datetime.datetime.fromisoformat(wanted[0]), wanted[1])), stem
    assert one(spark, times.anniversary_offset(F.lit("2020-02-29").cast("date"), F.lit("2023-02-27").cast("date"))) == 1


def test_upserts_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    new = spark.createDataFrame([(2, None), (3, 30)], "id long, v long")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(tables.upsert(old, new, ["id"])) == [(1, 10), (2, None), (3, 30)]
    assert rows(tables.merge_known(old, new, ["id"])) == [(1, 10), (2, 20), (3, 30)]
    assert rows(tables.insert_missing(old, new, ["id"])) == [(1, 10), (2, 20), (3, 30)]
    catalog = snapshots.Catalog(spark, str(tmp_path))
    schema = "id long, v long"
    assert catalog.read("t", schema).count() == 0
    done = lambda todo: todo.withColumn("v", F.col("v") * 2)
    wanted = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id long, v long, version long")
    full = "id long, v long, version long"
    assert snapshots.stage(catalog, "r", full, "id", ["version"], wanted, done) == 2
    assert snapshots.stage(catalog, "r", full, "id", ["version"], wanted, done) == 0
    changed = spark.createDataFrame([(1, 10, 2), (2, 20, 1)], full)
    assert snapshots.stage(catalog, "r", full, "id", ["version"], changed, done) == 1
    with pytest.raises(snapshots.Conflict):
        catalog.publish("r", wanted, expected=1)
    assert catalog.undo("r", full) == 3 and {r.version for r in catalog.read("r", full).collect()} == {1}
    assert {r.version for r in catalog.read("r", full, 2).collect()} == {1, 2}
    groups = spark.createDataFrame([("a", 1), ("b", 2)], "key string, id long")
    again = tables.replaced(groups, spark.createDataFrame([("b",), ("c",)], "key string"), "key", "id")
    assert sorted((r.key, r.id) for r in again.collect()) == [("b", 2), ("c", 3)]
    assert tables.replaced(groups, groups.drop("id").limit(0), "key", "id") is groups


def test_shards_and_trees(spark):
    df = spark.createDataFrame([(f"nas:/p/{i}.jpg",) for i in range(10)], "path string")
    out = scopes.even_shards(df, "path", 3).collect()
    assert sorted(sum(r.shard == i for r in out) for i in range(3)) == [3, 3, 4] and len({r.path for r in out}) == 10
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long")
    assert sorted(map(tuple, trees.closure(loop).collect())) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 2), (3, 3, 0)]
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id long, parent long")
    assert max(r.distance for r in trees.closure(deep).collect()) == 11
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(200)], "name string").repartition(7)
    people = spark.createDataFrame([(5, "n003"), (9, "x")], "id long, name string")
    got = {r.name: r.id for r in tables.found_or_created(names, people).collect()}
    assert len(got) == 201 and got["n003"] == 5 and [got[f"n{i:03d}"] for i in range(200) if i != 3] == list(range(10, 209))


def test_two_publishers_from_one_version(spark, tmp_path, monkeypatch):
    catalog = snapshots.Catalog(spark, str(tmp_path))
    one, three = spark.range(1), spark.range(3)
    assert catalog.publish("t", three) == 1
    monkeypatch.setattr(catalog, "version", lambda table: 0)  # what the second one read before the first had published
    with pytest.raises(snapshots.Conflict):
        catalog.publish("t", one)
    monkeypatch.undo()
    assert catalog.version("t") == 1 and catalog.read("t", "id long").count() == 3 and catalog.publish("t", one, 1) == 2
    assert catalog.read("t", "id long").count() == 1 and catalog.read("t", "id long", 1).count() == 3


def frames_of(ts, vectors, score=None, bits=None, **more):
    n = len(ts)
    return curation.Frames.of(pd.DataFrame({"key": range(n), "ts": ts, "score": np.zeros(n) if score is None else score, "vector": list(vectors), "bits": [None] * n if bits is None else bits, **more}))


def test_events_by_time_scene_and_place():
    a, b = np.eye(4)[0], np.eye(4)[1]
    starts = lambda ts, vectors, lat=None, lon=None, **more: curation.event_starts(frames_of(np.array(ts, float), vectors, **more), *(np.full(len(ts), np.nan) if x is None else np.array(x, float) for x in (lat, lon))).tolist()
    assert starts([0, 3600, 10 * 3600], [a, a, a]) == [True, False, True]
    assert starts([0, 7200], [a, a]) == [True, False] and starts([0, 7200], [a, b]) == [True, True]
    assert starts([0, 7200], [a, b], model=["x", "y"]) == [True, False] and starts([0, 7200], [a, None]) == [True, False]
    assert starts([0, 2400], [a, a], [55.75, 59.93], [37.6, 30.3]) == [True, True]  # two places, forty minutes apart
    assert starts([0, 2400], [a, a], [55.75, 55.76], [37.6, 37.6]) == [True, False] and starts([0, 600], [a, a], [55.75, 59.93], [37.6, 30.3]) == [True, False]


def test_series_and_diversity():
    rng = np.random.default_rng(0)
    scene = np.array([np.eye(32)[0] + rng.normal(0, 0.02, 32) for _ in range(30)])
    vectors = np.vstack((scene, np.eye(32)[1:9]))
    score = np.r_[np.full(30, 0.9), np.full(8, 0.6)]
    ts = np.r_[np.arange(30.0) * 60, np.arange(8) * 86400.0 + 10**6]
    bits = [int(x) for x in rng.integers(0, 2**62, 38)]
    f = frames_of(ts, vectors, score, bits)
    of = curation.series(f)
    assert len(set(of[:30])) == 1 and (of[30:] == np.arange(30, 38)).all()
    trace = curation.diversified(f, {"day": (ts // 86400, 0.08)}, 12)
    picked = trace.index[trace["decision"] == "selected"]
    assert sum(picked < 30) <= 2 and set(range(30, 38)) <= set(picked) and (trace["decision"][:30] == "same_scene").sum() >= 28
    assert trace["pick"][picked].sort_values().tolist() == list(range(1, len(picked) + 1))
    # a frame without vector and hash is like nothing; one with a hash alone joins the frame of nearly the same hash
    odd = frames_of(np.arange(3.0) * 1000, [np.eye(4)[0], None, None], np.array([0.9, 0.8, 0.7]), [7, None, 5])
    assert curation.series(odd).tolist() == [0, 1, 0]


def test_small_events_are_on_the_shortlist():
    f = frames_of(np.arange(103.0), [None] * 103, np.r_[np.full(100, 0.9), np.full(3, 0.5)])
    event = np.r_[np.zeros(100), [1, 1, 1]].astype(int)
    assert set(curation.shortlist(f, event, 10)) == {*range(60), 100, 101}


def test_representatives_take_reliable_ones_first():
    assert curation.representatives(np.ones(4), np.array([0, 0.1, 1, 2.0]), np.eye(4)) == [0, 2, 3]
    quality, ts = np.array([0.9, 0.5, 0.8, 0.7]), np.arange(4.0)
    assert curation.representatives(quality, ts, np.eye(4), np.array([False, True, False, True]), most=3) == [3, 1, 0]
    like = np.array([[1.0, 0], [1, 0], [0, 1]])
    assert curation.representatives(np.array([0.9, 0.8, 0.5]), np.arange(3.0), like, most=2) == [0, 2]  # 0.8 * 0.5 against 0.5 * 1


def test_linkage_against_all_merges():
    rng = np.random.default_rng(3)
    for _ in range(10):
        v = rng.standard_normal((14, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        groups = [{i} for i in range(14)]
        while len(groups) > 1:
            d, a, b = min((np.mean([1 - v[x] @ v[y] for x in a for y in b]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
            if d > 0.7:
                break
            groups[a] |= groups.pop(b)
        got = clusters.average_linkage(v, 0.7, 1)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)} == {frozenset(g) for g in groups}
        assert len(set(clusters.average_linkage(v, count=4))) == 4


def test_stitching_keeps_tracks_apart():
    banks = [np.array([[1.0, 0]]), np.array([[0.99, math.sqrt(1 - 0.99**2)]]), np.array([[0.98, math.sqrt(1 - 0.98**2)]])]
    assert len(set(clusters.stitched(banks, set()))) == 1
    got = clusters.stitched(banks, {(0, 1)})
    assert got[0] != got[1] and len(set(got)) == 2
    assert (clusters.density(np.array([[1.0, 0], [1, 0.01], [1, 0.02], [0, 1]]) / 1.0, 0.1, 3) == [0, 0, 0, -1]).all()


def test_hash_pairs_and_components(spark):
    rng = np.random.default_rng(8)
    hashes = [int(x) for x in rng.integers(0, 2**62, 30)]
    hashes += [h ^ (1 << int(rng.integers(0, 62))) for h in hashes[:10]] + hashes[:3] + [-5, -7]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    got = {(r.a, r.b) for r in matching.hash_pairs(df, "id", "h").collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    wanted = {(min(i, j), max(i, j)) for (g, i), (h, j) in itertools.combinations(first.items(), 2) if ((g ^ h) & (2**64 - 1)).bit_count() <= 3}
    assert got == wanted
    near = matching.hash_pairs(df.withColumn("h", F.col("h").bitwiseAND((1 << 20) - 1)), "id", "h", 6, bits=20)
    small = {}
    for i, h in enumerate(hashes):
        small.setdefault(h & (1 << 20) - 1, i)
    assert {(r.a, r.b) for r in near.collect()} == {(min(i, j), max(i, j)) for (g, i), (h, j) in itertools.combinations(small.items(), 2) if (g ^ h).bit_count() <= 6}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in matching.components(edges, snapshots.written).collect()}
    assert set(roots.values()) == {0, 100} and roots[40] == 0


def test_banks_and_labels_by_broadcast_and_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(40, 3))]
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:15])], "q long, v array<double>")
    bank = spark.createDataFrame([(f"p{i % 4}", i, v) for i, v in enumerate(vectors)], "person string, sample long, p array<double>")
    for best in (None, 2):
        once, blocks = (sorted((r.q, r.person, r.sample, r.sim) for r in matching.bank_scores(queries, bank, rows, best).collect()) for rows in (100, 6))
        assert [x[:3] for x in once] == [x[:3] for x in blocks] and len(once) == 15 * (4 * best if best else 40)
        assert np.allclose([x[3] for x in once], [x[3] for x in blocks], atol=2e-6)
    samples = spark.createDataFrame([(i, i % 5, i // 4, v) for i, v in enumerate(vectors)], "vec_id long, label long, file long, embedding array<double>")
    wanted = {}
    for i, label in itertools.product(range(40), range(5)):
        if others := [j for j in range(40) if j % 5 == label and j // 4 != i // 4]:
            wanted[i, label] = np.mean([np.dot(vectors[i], vectors[j]) for j in others])
    for rows in (100, 2):
        got = {(r.q, r.person): r.score for r in matching.leave_one_out(samples, rows).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_rows_whose_value_repeats(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None), (5, None), (6, 7)], "id long, size long")
    assert sorted(r.id for r in tables.repeated(df, "size").collect()) == [1, 2, 4, 5]
    assert tables.repeated(df, "size", most=1).count() == 6  # too many values to send: the test is left out
    assert tables.repeated(df.limit(0), "size").count() == 0


def test_sessions_buckets_and_running_means(spark, tmp_path):
    events = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, h), h) for h in (0, 5, 11)], "u long, ts timestamp, h int")
    assert sorted(r.n for r in tracks.sessions(events, "u", "ts").collect()) == [1, 2]
    hours = {r.start.hour: r.n for r in tracks.buckets(events, "ts", "4 hours").collect()}
    assert hours == {0: 1, 4: 1, 8: 1}
    prints = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 4.0]), ("a", [2.0, 2.0])], "k string, vector array<double>")
    wanted = {("a", 0): (1.0, 3), ("a", 1): (1.0, 3), ("b", 0): (2.0, 1), ("b", 1): (4.0, 1)}
    assert {(r.k, r.pos): (r.mean, r.n) for r in tracks.running_means(prints, "k").collect()} == wanted
    for i, part in enumerate((prints.limit(2), prints.subtract(prints.limit(2)))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = tracks.running_means(stream, "k").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.pos): (r.mean, r.n) for r in spark.table("means").collect()} == wanted


def test_sources(spark, tmp_path):
    for name, size in (("a.jpg", 1), ("sub/b.PNG", 2), ("sub/note.txt", 3), ("trash/c.jpg", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = sorted((r.path, r.size, r.kind) for r in files.inventory(spark, str(tmp_path), "box").collect())
    assert got == [("box:/a.jpg", 1, "photo"), ("box:/sub/b.PNG", 2, "photo")]
    said = spark.createDataFrame([('```json {"a": ["x", "y"], "b": []} ```',)], "t string")
    asked = spark.createDataFrame([("a",), ("b",)], "item string")
    assert sorted(map(tuple, files.answers(said, "t", asked).collect())) == [("a", "x"), ("a", "y")]
    with pytest.raises(ValueError, match="differ"):
        files.answers(said, "t", asked.limit(1))
    assert one(spark, files.frame_times(F.lit(10.0), 4)) == [1.25, 3.75, 6.25, 8.75]


def test_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string").withColumn("v", models.encoded(models.HashModel(4), F.col("t")))
    v = {r.id: r.v for r in df.collect()}
    assert v[1] == v[2] and v[3] is None and abs(np.linalg.norm(v[1]) - 1) < 1e-9
    scores = models.label_scores(df.where("v is not null"), "id", "v", {"x": v[1], "y": [0.0] * 4}, {"x": [0.0] * 4, "y": v[1]}).collect()
    assert {(r.id, r.label): r.score > 0.5 for r in scores} == {(1, "x"): True, (1, "y"): False, (2, "x"): True, (2, "y"): False}


def test_stitching_goes_through_sorted_pairs():
    """Against a plain version: sets of tracks, pairs by their own score, merged if the least score across reaches the floor."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(2, 9))
        v = rng.normal(size=(n, 3)) + rng.choice([[1, 0, 0], [0, 1, 0]], n)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        apart = {(int(a), int(b)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.15}
        groups = [{i} for i in range(n)]
        for a, b in sorted(itertools.combinations(range(n), 2), key=lambda p: (-(v[p[0]] @ v[p[1]]), p)):
            x, y = (next(g for g in groups if i in g) for i in (a, b))
            if x is not y and all(v[i] @ v[j] >= 0.5 and (min(i, j), max(i, j)) not in apart for i in x for j in y):
                groups = [g for g in groups if g is not x and g is not y] + [x | y]
        got = clusters.stitched([x[None] for x in v], {(b, a) for a, b in apart}, 0.5)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)} == {frozenset(g) for g in groups}
    bonus = np.zeros((3, 3))
    bonus[1, 2] = 0.5
    three = [np.array([[1.0, 0]]), np.array([[math.cos(0.5), math.sin(0.5)]]), np.array([[math.cos(1.1), math.sin(1.1)]])]
    assert clusters.stitched(three, set(), 0.7).tolist() == [0, 0, 1] and clusters.stitched(three, set(), 0.7, bonus).tolist() == [0, 1, 1]


def label_frames(spark, *rows):
    return [spark.createDataFrame(r, "key long, label long") for r in rows]


def test_stable_labels(spark):
    final = lambda old, new, **o: {r.label: r.final for r in clusters.stable_labels(*reversed(label_frames(spark, old, new)), snapshots.written, **o).collect()}
    assert final([(1, 5), (2, 5), (3, 7), (4, 7)], [(1, 0), (2, 0), (3, 1), (9, 2)]) == {0: 5, 1: 7, 2: 8}
    assert final([(1, 9), (2, 9), (3, 2), (4, 2)], [(1, 0), (2, 0), (3, 0), (4, 0)]) == {0: 2}  # a tie: the smaller old label
    assert final([(1, -1), (2, -1), (3, -1), (4, 2), (5, 2)], [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, -1)]) == {0: 3, 1: 2}
    assert final([], [(1, 4), (2, 6), (None, 8)], highest=10) == {4: 11, 6: 12}


def test_one_to_one_equals_taking_the_highest_first(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)): float(s) for a, b, s in zip(rng.integers(0, 30, 200), rng.integers(0, 25, 200), rng.integers(0, 9, 200), strict=True)}.items())
    used_a, used_b, wanted = set(), set(), set()
    for (a, b), s in sorted(edges, key=lambda e: (-e[1], e[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            wanted.add((a, b, s))
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges], "a long, b long, score double")
    assert {tuple(r) for r in matching.one_to_one(df, snapshots.written).collect()} == wanted
    assert matching.one_to_one(df.limit(0), snapshots.written).collect() == []


def test_an_empty_pointer_is_no_version(spark, tmp_path, monkeypatch):
    catalog = snapshots.Catalog(spark, str(tmp_path))
    one = spark.range(1)
    assert catalog.publish("t", one) == 1
    (tmp_path / "t" / "_versions" / "2").touch()  # a writer that died, or is about to write
    assert catalog.version("t") == 1 and catalog.read("t", "id long").count() == 1
    with pytest.raises(snapshots.Conflict):
        catalog.publish("t", spark.range(2))
    monkeypatch.setattr(snapshots, "PATIENCE", -1.0)
    assert catalog.publish("t", spark.range(2)) == 2 and catalog.read("t", "id long").count() == 2
