"""The whole identity build on planted people, and its steps against plain versions."""

import itertools

import numpy as np
import pytest

from tessera.operators import identities as I
from tessera.operators import people as P
from tessera.operators.clusters import pair_score
from tessera.operators.snapshots import written

SAMPLES = "file string, track long, ts double, quality double, core boolean, vector array<double>, year int, people int"
STILLS = "file string, key long, quality double, vector array<double>, year int"
GIVEN, OLD = "key long, person long", "key long, label long"


def face(rng, person, spread=0.12, dims=8):
    v = np.zeros(dims)
    v[person] = 1
    v += spread * rng.normal(size=dims) / np.sqrt(dims)
    return (v / np.linalg.norm(v)).tolist()


def planted(rng, people=4, files=5):
    """Files in which everybody appears, two at a time in each moment; pictures of one person each, some of two who look the same."""
    samples, stills, truth = [], [], {}
    for f in range(files):
        for who in range(people):
            for piece in range(2):
                key = 1000 + f * 100 + who * 10 + piece
                truth[key] = who
                for k in range(3):
                    samples.append((f"v{f}", key, float(piece * 10 + k), 0.9 - 0.1 * k, True, face(rng, who), 2020, None))
    for i in range(60):
        who = i % people
        stills.append((f"p{i}", i, 0.8, face(rng, who), 2020))
        truth[i] = who
        if i % 6 == 0:  # a twin in the same picture
            stills.append((f"p{i}", 500 + i, 0.7, face(rng, who), 2020))
            truth[500 + i] = who
    return samples, stills, truth


def run(spark, samples, stills, given=(), old=(), **options):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema).repartition(3)
    apart = df(options.pop("apart"), "a long, b long") if "apart" in options else None
    return P.build(df(samples, SAMPLES), df(stills, STILLS), df(given, GIVEN), df(old, OLD), written, apart=apart, **options)


def scenes_of(samples, stills, apart=()):
    out = {}
    for f, track, ts, *_ in samples:
        out.setdefault(track, set()).add((f, ts))
    for f, key, *_ in stills:
        out.setdefault(key, set()).add(f)
    for a, b in apart:
        for k in (a, b):
            out.setdefault(k, set()).add(("pair", a, b))
    return out


def broken(labels, scenes):
    """Pairs of keys of one label that share a scene."""
    return [(a, b) for a, b in itertools.combinations(sorted(labels), 2) if labels[a] == labels[b] >= 0 and scenes[a] & scenes[b]]


def test_planted_people(spark):
    samples, stills, truth = planted(np.random.default_rng(1))
    apart = [(0, 4), (1000, 1100)]  # the same person by their looks, kept apart by hand
    given = [(2, 77), (1020, 77), (8, 88)]  # key 2 and track 1020 are person 2; key 8 is person 0
    old = [(k, {0: 5, 1: 9, 2: 3, 3: 7}[who]) for k, who in truth.items()] + [(9999, 40)]
    out = run(spark, samples, stills, given, old, apart=apart, least_group=2, named_margin=0.05)
    labels = {r.key: r.label for r in out.labels.collect()}
    assert set(labels) == set(truth)
    assert not broken(labels, scenes_of(samples, stills, apart))
    people = {}
    for k, label in labels.items():
        if label >= 0:
            people.setdefault(label, set()).add(truth[k])
    assert all(len(who) == 1 for who in people.values())  # nobody is mixed
    assert {labels[k] for k in truth if k < 60 and truth[k] == 2 and k % 6} == {3}  # the old label stays with its largest group
    assert {labels[1010], labels[1110], labels[5]} == {labels[1010]} or labels[1010] == labels[1110]  # tracks of several files meet
    assert all(label in (3, 5, 7, 9) or label > 40 for label in labels.values() if label >= 0)
    names = {r.unit: (r.person, r.manual) for r in out.names.collect()}
    by_truth = {77: 2, 88: 0}
    assert names[2] == (77, True) and names[8] == (88, True)
    units = {r.unit: r for r in out.units.collect()}
    assert all(truth[m] == by_truth[person] for u, (person, _) in names.items() for m in units[u].members)
    assert sum(not manual for _, manual in names.values()) > 5


def test_no_constraint_is_broken_on_random_vectors(spark):
    rng = np.random.default_rng(7)
    vector = lambda: rng.normal(size=3).tolist()
    samples = [(f"v{f}", f * 10 + t, float(rng.integers(0, 4)), float(rng.random()), bool(rng.random() < 0.7), vector(), None, 2 if f % 2 else None) for f in range(6) for t in range(6) for _ in range(3)]
    stills = [(f"p{i // 3}", 200 + i, None, vector(), int(rng.integers(2000, 2020))) for i in range(60)]
    given = [(int(k), int(k) % 3) for k in rng.choice([r[1] for r in samples] + [r[1] for r in stills], 15)]
    apart = [(200, 204), (0, 230), (11, 12)]
    out = run(spark, samples, stills, dict(given).items(), [], apart=apart, people="people", least_group=1, stitch=0.4, single=0.4, named=0.4, named_margin=0.0, child_margin=0.0, group_floor=0.0)
    labels = {r.key: r.label for r in out.labels.collect()}
    unit_of = {m: r.unit for r in out.units.collect() for m in r.members}
    scenes = scenes_of(samples, stills, apart)
    assert len(set(labels.values())) > 3 and set(labels) == {r[1] for r in samples} | {r[1] for r in stills}
    assert [(a, b) for a, b in broken(labels, scenes) if unit_of[a] != unit_of[b]] == []
    named = {r.unit: r.person for r in out.names.collect()}
    for label in set(labels.values()) - {-1}:
        assert len({named[unit_of[k]] for k, x in labels.items() if x == label and unit_of[k] in named}) <= 1
    spots = [(s, named[unit_of[k]], unit_of[k]) for k in unit_of if unit_of[k] in named for s in scenes[k]]
    assert all(len({u for s, n, u in spots if (s, n) == key}) == 1 for key in {(s, n) for s, n, _ in spots})


def test_banks_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in (1, 2, None):
        v = np.array([face(rng, int(rng.integers(0, 3)), 0.9) for _ in range(12)])
        v[5] = v[2]
        rows += [(g, i, float(q), x.tolist()) for i, (q, x) in enumerate(zip(rng.integers(1, 5, 12) / 4, v, strict=True))]
    df = spark.createDataFrame(rows, "g long, key long, weight double, vector array<double>")
    got = {r.g: (r.n, np.array(r.bank)) for r in P.diverse_banks(df, ["g"], written).collect()}
    for g in (1, 2, None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        v = np.array([r[3] for r in own])
        assert got[g][0] == 12 and np.allclose(got[g][1], v[I.varied(np.array([r[2] for r in own]), v)])


def test_a_profile_leaves_the_own_file_out(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), i, f"f{int(rng.integers(0, 6))}", [None, 2001, 2004, 2005][int(rng.integers(0, 4))], float(rng.random()), face(rng, int(rng.integers(0, 3)), 0.8)) for i in range(120)]
    got = {(r.person, r.without): {p.start: (p.n, np.array(p.bank)) for p in r.periods} for r in P.profiles(spark.createDataFrame(rows, "person long, key long, file string, year int, weight double, vector array<double>"), written).collect()}
    period = lambda y: 0 if y is None else y - y % 3
    wanted = {}
    for person in range(3):
        files = {r[2] for r in rows if r[0] == person}
        for without in (None, *files):
            for start in {period(r[3]) for r in rows if r[0] == person}:
                own = sorted((r for r in rows if r[0] == person and period(r[3]) == start and r[2] != without), key=lambda r: (-r[4], r[1]))
                if own:
                    v = np.array([r[5] for r in own])
                    wanted.setdefault((person, without), {})[start] = (len(own), v[I.varied(np.array([r[4] for r in own]), v)])
    assert set(got) == set(wanted)
    for key, periods in wanted.items():
        assert set(got[key]) == set(periods)
        for start, (n, bank) in periods.items():
            assert got[key][start][0] == n and np.allclose(got[key][start][1], bank)


def test_blocks_of_people_find_the_same(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, f"f{i % 4}", None if i % 5 == 0 else 2001.0 + i % 9, [face(rng, int(rng.integers(0, 5)), 0.5) for _ in range(i % 3 + 1)]) for i in range(40)], "unit long, file string, year double, bank array<array<double>>")
    views = spark.createDataFrame([(i % 9, i, f"f{i % 5}", 2000 + i % 7, 0.5, face(rng, i % 5, 0.5)) for i in range(90)], "person long, key long, file string, year int, weight double, vector array<double>")
    known = written(P.profiles(views, written))
    one, many = ({r.unit: tuple(r) for r in P.likest_people(rows, known, P.RULES, most).collect()} for most in (10_000, 20))
    assert len(one) == 40 and set(one) == set(many)
    for u, r in one.items():
        assert r[1] == many[u][1] and r[2:] == pytest.approx(many[u][2:])


def test_a_person_who_ages_must_lead_by_more():
    young, grown = [1.0, 0, 0], [0.6, 0.8, 0]
    of = lambda *x: [{"start": s, "n": n, "bank": b} for s, n, b in x]
    assert P._aged(of((2001, 2, [young]), (2010, 2, [grown])), 0.86)
    assert not P._aged(of((2001, 2, [young]), (2010, 1, [grown])), 0.86) and not P._aged(of((0, 9, [young]), (2010, 2, [grown])), 0.86)
    assert P._nearest(of((0, 1, ["x"]), (2001, 1, ["y"]), (2010, 1, ["z"])), 2004) == ["y"] and P._nearest(of((0, 1, ["x"]), (2001, 1, ["y"])), None) == ["x", "y"]
    assert P.likeness(np.array([[0.9, 0.8, 0.7, 0.1]])) == (pytest.approx(0.8), 3) and P.likeness(np.zeros((2, 0))) == (-1.0, 0)
    sims = np.array([[0.9, 0.8], [0.85, 0.1]])
    assert P.likeness(sims) == (pytest.approx(pair_score(sims, np.eye(2))), 2)


def test_empty(spark):
    out = run(spark, [], [])
    assert [df.collect() for df in (out.identities, out.units, out.names, out.labels)] == [[], [], [], []]
