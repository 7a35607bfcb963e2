"""Identities of a file and compatible parts, on planted vectors and against plain versions."""

import numpy as np
import pytest

from tessera.operators import clusters
from tessera.operators import identities as I


def unit(*x):
    v = np.array(x, float)
    return v / np.linalg.norm(v)


def near(v, angle, axis):
    """v turned by an angle whose cosine is given, towards an axis."""
    w = np.zeros(len(v))
    w[axis] = 1
    return angle * v + np.sqrt(1 - angle * angle) * w


A, B = unit(1, 0, 0, 0, 0, 0), unit(0, 1, 0, 0, 0, 0)


def none(n):
    return np.zeros((n, n), bool)


def test_varied_prefers_quality_then_difference_and_drops_equals():
    vectors = np.array([A, A, near(A, 0.9, 3), B])
    assert I.varied(np.array([1.0, 0.99, 0.9, 0.6]), vectors) == [0, 3, 2]
    assert I.varied(np.array([1.0, 1.0]), np.array([A, B]), most=1) == [0]


@pytest.mark.parametrize(("cosine", "want"), [(0.79, 0), (0.77, -1)])
def test_one_pair_needs_the_single_threshold(cosine, want):
    banks = [A[None], near(A, cosine, 4)[None]]
    assert I.attached(banks, np.array([0, -1]), none(2)).tolist() == [0, want]


def test_several_pairs_need_less():
    banks = [np.array([A, A]), np.array([near(A, 0.75, 4), near(A, 0.75, 5)])]
    assert I.attached(banks, np.array([0, -1]), none(2)).tolist() == [0, 0]


def test_a_second_identity_within_the_margin_keeps_a_track_open():
    weak = unit(1, 0.95, 0, 0, 0, 0)
    close = unit(1, 0.2, 0, 0, 0, 0), unit(0.2, 1, 0, 0, 0, 0)
    banks = [close[0][None], close[1][None], weak[None]]
    assert I.attached(banks, np.array([0, 1, -1]), none(3))[2] == -1
    assert I.attached(banks[::2], np.array([0, -1]), none(2))[1] == 0


def test_attached_tracks_bar_what_they_are_kept_apart_from():
    banks = [A[None]] * 3
    cannot = none(3)
    cannot[1, 2] = cannot[2, 1] = True
    assert I.attached(banks, np.array([0, -1, -1]), cannot).tolist() == [0, 0, -1]


def fragments(*vectors):
    return [v[None] for v in vectors], {i: (np.ones(1), v[None]) for i, v in enumerate(vectors)}


def test_fragments_join_until_the_target_and_never_across_conflicts():
    banks, views = fragments(A, near(A, 0.95, 2), near(A, 0.9, 3), B)
    core, label = np.ones(4, bool), np.arange(4)
    assert I.joined(banks, label, core, views, none(4)).tolist() == [0, 0, 0, 3]
    assert I.joined(banks, label, core, views, none(4), target=3).tolist() == [0, 0, 2, 3]
    cannot = none(4)
    cannot[0, 1] = cannot[1, 0] = True
    assert I.joined(banks, label, core, views, cannot)[:2].tolist() == [0, 1]


def test_a_hint_fills_empty_identities_and_gives_one_more_where_all_are_barred():
    banks = [A[None], B[None], near(A, 0.5, 3)[None]]
    assert I.hinted(banks, np.array([0, -1, -1]), none(3), 2).tolist() == [0, 1, 0]
    assert I.hinted(banks, np.array([0, -1, -1]), none(3), 1).tolist() == [0, 0, 0]
    assert I.hinted(banks, np.array([0, -1, -1]), ~np.eye(3, dtype=bool), 2).tolist() == [0, 1, 2]
    assert I.hinted(banks, np.full(3, -1), none(3), 0).tolist() == [0, 0, 0] or I.hinted(banks, np.full(3, -1), none(3), 0)[0] == 0


def test_first_fit_equals_a_plain_version():
    vectors = np.random.default_rng(5).normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    got, parts = I.first_fit(vectors, 0.3), []
    for i in range(60):
        home = [p for p in parts if min(vectors[i] @ vectors[j] for j in p) >= 0.3]
        home[0].append(i) if home else parts.append([i])
    assert [[*np.flatnonzero(got == k)] for k in range(len(parts))] == parts


def test_file_identities_in_spark(spark):
    rows = [
        ("f", 1, 0.0, 1.0, True, A.tolist(), 3),
        ("f", 1, 1.0, 0.9, True, near(A, 0.97, 2).tolist(), 3),
        ("f", 2, 0.0, 1.0, True, B.tolist(), 3),
        ("f", 3, 5.0, 0.2, False, near(A, 0.98, 4).tolist(), 3),
        ("f", 4, 5.0, 0.2, False, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 3),
        ("f", None, 5.0, 0.2, False, A.tolist(), 3),
        ("f", 5, 6.0, 0.2, None, None, 3),
        (None, 1, None, None, None, A.tolist(), None),
    ]
    df = spark.createDataFrame(rows, "file string, track long, ts double, quality double, core boolean, vector array<double>, people int")
    got = {(r.file, r.track): (r.identity, r.role) for r in I.file_identities(df, "file").collect()}
    assert got == {("f", 1): (0, "core"), ("f", 2): (1, "core"), ("f", 3): (0, "attached"), ("f", 4): (-1, "open"), (None, 1): (-1, "open")}
    got = {(r.file, r.track): (r.identity, r.role) for r in I.file_identities(df, "file", people="people").collect()}
    assert got[("f", 4)] == (2, "hinted") and got[("f", 3)] == (0, "attached")
    assert I.file_identities(df.limit(0), "file").count() == 0


def test_compatible_parts_in_spark(spark):
    df = spark.createDataFrame([("g", 1, A.tolist()), ("g", 2, B.tolist()), ("g", 3, near(A, 0.9, 2).tolist()), ("h", 1, A.tolist()), ("h", 2, None)], "g string, key long, vector array<double>")
    got = {(r.g, r.key): r.part for r in I.compatible_parts(df, "g", 0.5).collect()}
    assert got == {("g", 1): 0, ("g", 2): 1, ("g", 3): 0, ("h", 1): 0}


def test_compatible_parts_of_a_large_group(spark):
    """More rows than one task took before."""
    v = np.random.default_rng(1).normal(size=(12_500, 2))
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v.tolist())], "g string, key long, vector array<double>")
    parts = {r.key: r.part for r in I.compatible_parts(df, "g", 0.0).collect()}
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lows, wanted = [], []
    for x in v:
        wanted.append(next((k for k, members in enumerate(lows) if (np.array(members) @ x >= 0).all()), len(lows)))
        if wanted[-1] == len(lows):
            lows.append([])
        lows[wanted[-1]].append(x)
    assert [parts[i] for i in range(len(v))] == wanted


def some_banks(r, n):
    out = []
    for _ in range(n):
        v = r.normal(size=(int(r.integers(1, 6)), 3))
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    return out


def test_scores_in_strips_equal_single_ones():
    a, b = some_banks(np.random.default_rng(1), 40), some_banks(np.random.default_rng(2), 30)
    got = np.vstack([scores for _, scores in clusters.score_strips(a, b)])
    assert got == pytest.approx(np.array([[clusters.pair_score(x, y) for y in b] for x in a]))


def test_no_pair_of_tracks_is_scored_alone(monkeypatch):
    """Before, each two tracks were one call: minutes for some thousand tracks of a file."""
    calls = []

    def counted(a, b, most=3, whole=clusters.pair_score):
        calls.append(1)
        return whole(a, b, most)

    monkeypatch.setattr(clusters, "pair_score", counted)
    monkeypatch.setattr(I, "pair_score", counted)
    banks = some_banks(np.random.default_rng(3), 120)
    core, cannot = np.arange(120) % 3 > 0, none(120)
    at, label = np.flatnonzero(core), np.full(120, -1)
    label[at] = clusters.stitched([banks[i] for i in at], set(), 0.65)
    views = {i: (np.ones(len(b)), b) for i, b in enumerate(banks)}
    out = I.joined(banks, I.attached(banks, label, cannot), core, views, cannot, 3)
    out[out >= 0] = np.unique(out[out >= 0], return_inverse=True)[1]
    dealt = I.hinted(banks, out, cannot, 3)
    assert (dealt >= 0).all() and len(calls) < 1000


def test_a_file_of_more_samples_than_before_is_stitched(spark):
    df = spark.range(20_400).selectExpr("'f' AS file", "floor(id / 100) AS track", "id * 1D AS ts", "array(cast(floor(id / 100) % 3 = 0 AS double), cast(floor(id / 100) % 3 = 1 AS double), cast(floor(id / 100) % 3 = 2 AS double)) AS vector")
    got = {r.track: r.identity for r in clusters.track_identities(df, "file", 0.3).collect()}
    assert got == {t: t % 3 for t in range(204)}
