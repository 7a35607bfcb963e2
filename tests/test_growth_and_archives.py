"""Clusters that grow by steps, speech, archives, prompts, ranks by ranges, exports: planted cases and plain versions."""

import hashlib
import io
import json
import random
import statistics
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cards, clusters, scopes, tables
from tessera.sources import archives, files


def plain_growth(sums, rows, threshold, least):
    """One step, row by row: (key -> label, how) and the sums after it."""
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
    names = sorted(sums)
    centres = [unit(sums[k]) for k in names]
    out, rest = {}, []
    for key, vector in sorted(rows):
        likes = [round(float(unit(vector) @ c), 6) for c in centres]
        if likes and max(likes) >= threshold:
            out[key] = (names[likes.index(max(likes))], "nearest")
        else:
            rest.append((key, vector))
    fresh = clusters.average_linkage(np.array([unit(v) for _, v in rest]), least=least) if rest else []
    top = max(names, default=-1)
    out |= {key: (int(label) + top + 1, "average") if label >= 0 else (-1, "none") for (key, _), label in zip(rest, fresh, strict=True)}
    after = {k: np.array(v, float) for k, v in sums.items()}
    for key, vector in rows:
        if out[key][0] >= 0:
            after[out[key][0]] = after.get(out[key][0], 0) + unit(vector)
    return out, after


def test_growth_against_a_plain_version(spark):
    r = np.random.default_rng(4)
    middles = np.eye(8)
    near = lambda i: (middles[i] + r.normal(0, 0.12, 8)).tolist()
    steps = [[(k, near(r.integers(0, 4 if k < 40 else 8))) for k in range(n, n + 30)] for n in (0, 30, 60)]
    schema = "key long, vector array<double>"
    sums, plain = clusters.centre_sums(spark.createDataFrame([], "label long, vector array<double>")), {}
    for step in steps:
        labels, sums = clusters.grown(sums, spark.createDataFrame([*step, (None, [1.0] * 8), (1000, [0.0] * 8), (1001, None)], schema), 0.6, 3)
        wanted, plain = plain_growth(plain, step, 0.6, 3)
        assert {x.key: (x.label, x.how) for x in labels.collect()} == wanted
        got = {}
        for x in sums.collect():
            got.setdefault(x.label, {})[x.pos] = x.s
        assert set(got) == set(plain) and all(got[k][i] == pytest.approx(plain[k][i]) for k in plain for i in range(8))
    assert {h for _, h in wanted.values()} >= {"nearest"} and len(plain) > 4


def test_growth_by_nothing(spark):
    labels, sums = clusters.grown(clusters.centre_sums(spark.createDataFrame([(0, [1.0, 0.0]), (-1, [0.0, 1.0])], "label long, vector array<double>")), spark.createDataFrame([], "key long, vector array<double>"))
    assert labels.count() == 0 and {(x.label, x.pos, x.s) for x in sums.collect()} == {(0, 0, 1.0), (0, 1, 0.0)}


def test_speech_takes_the_best_evidence(spark):
    segments = spark.createDataFrame([("f", 2, 5.0, 6.0, "b", "s1"), ("f", 1, 1.0, 2.0, "a", "s2"), ("f", 3, 6.0, 7.0, "c", None), ("g", 1, 0.0, 1.0, "d", "s1")], "path string, ord int, start double, stop double, text string, speaker string")
    named = lambda *rows: spark.createDataFrame(list(rows), "path string, speaker string, name string, confidence double")
    got = cards.speech(segments, named(("f", "s1", "Ann", 0.1)).drop("confidence"), named(("f", "s1", "Bob", 0.99), ("f", "s2", "Cid", 0.5), ("f", "s2", "Bea", 0.5), ("g", "s1", None, 1.0)), named(("f", "s2", "Eve", 0.9), ("g", "s1", "Dan", 0.7)))
    rows = [(r.path, r.position, r.text, r["name"], r.confidence, r.source) for r in got.orderBy("path", "position").collect()]
    assert rows == [("f", 1, "a", "Bea", 0.5, "face"), ("f", 2, "b", "Ann", 1.0, "manual"), ("f", 3, "c", None, None, None), ("g", 1, "d", "Dan", 0.7, "voice")]


def test_archives_hold_pictures_and_questions(spark):
    items = [("b1", i, f"nas:/secret/{i}.jpg", bytes([i] * 50)) for i in (3, 1, 2)] + [("b2", 1, "nas:/x", b""), ("b3", 1, "nas:/none", None)]
    df = spark.createDataFrame(items, "id string, order int, path string, content binary")
    made = {r.id: bytes(r.archive) for r in archives.packed(df, {"cat": "a cat", "a": "first"}, "clip").collect()}
    again = {r.id: bytes(r.archive) for r in archives.packed(df.repartition(3), {"a": "first", "cat": "a cat"}, "clip").collect()}
    assert made == again and set(made) == {"b1", "b2"}
    with zipfile.ZipFile(io.BytesIO(made["b1"])) as z:
        assert [z.read(f"{i:02d}.jpg") for i in (1, 2, 3)] == [bytes([i] * 50) for i in (1, 2, 3)]
        assert json.loads(z.read("answer-template.json")) == {"batch_id": "b1", "items": [{"file": f"{i:02d}.jpg", "labels": []} for i in (1, 2, 3)]}
        assert [c["id"] for c in json.loads(z.read("categories.json"))] == ["a", "cat"] and "b1" in z.read("prompt.txt").decode()
        assert not any(b"secret" in z.read(n) for n in z.namelist())
    back = archives.unpacked(archives.packed(df, {}, "clip"))
    assert {(r.id, bytes(r.content)) for r in back.where("file LIKE '%.jpg'").collect()} == {(i, c) for i, _, _, c in items if c is not None}
    with pytest.raises(Exception, match="21 pictures"):
        archives.packed(spark.createDataFrame([("b", i, "p", b"x") for i in range(21)], df.schema), {}, "clip").collect()


def test_prompts_of_every_model(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, text string")
    stored = spark.createDataFrame([("m", "a", "1"), ("m", "b", "2"), ("m", "c", "3"), ("n", "a", "1"), ("n", "a", "1"), ("n", "b", "old"), ("o", "z", "0")], "model string, name string, text string")
    assert {tuple(r) for r in scopes.prompt_states(expected, stored).collect()} == {("m", 0, True), ("n", 1, False), ("o", 2, False)}


def test_standings_of_a_group_that_holds_nearly_all(spark):
    random.seed(8)
    rows = [("hot", random.randrange(300) / 4) for _ in range(3000)] + [("one", 5.0)] + [("even", x) for x in (1.0, 2.0, 2.0, 9.0)] + [("none", None), (None, 3.0)]
    got = {(r.g, r.v): r for r in tables.standings(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("hot", "one", "even"):
        values = [v for k, v in rows if k == g]
        assert {v for k, v in got if k == g} == set(values)
        for v in set(values):
            r = got[g, v]
            assert (r.below, r.total, r.median) == (sum(x < v for x in values), len(values), statistics.median(values))
    assert not any(k == "none" for k, _ in got)


def test_quick_keys_read_both_ends(spark):
    long = bytes(range(256)) * 40
    cases = {"short": b"abc", "none": b"", "long": long, "middle": long[:5000] + b"#" + long[5001:], "end": long[:-1] + b"#"}
    df = spark.createDataFrame(list(cases.items()), "name string, content binary").select("name", files.quick_key(F.col("content"), 1000).alias("k"))
    got = {r.name: r.k for r in df.collect()}
    plain = lambda x: hashlib.sha1(str(len(x)).encode() + b"\0" + x[:1000] + x[max(0, len(x) - 1000):]).hexdigest()
    assert got == {n: plain(x) for n, x in cases.items()} and got["long"] == got["middle"] != got["end"]


def test_export_leaves_copies_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", 5, "x"), ("b", "s1", 5, "y"), ("c", None, 0, "z")], "path string, sha string, size long, other string")
    files.export_hashes(rows, spark.createDataFrame([("b",)], "path string"), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["path"]) == [{"path": "a", "sha": "s1", "size": 5}, {"path": "c", "size": 0}]
