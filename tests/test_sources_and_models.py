"""Pictures' bytes, directory trees, detectors and thresholds."""

import os
import re
import struct
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import detectors, exif
from tessera.operators import calibration as K
from tessera.operators.snapshots import written
from tessera.sources import walk as W

SIZES = {2: 1, 3: 2, 4: 4, 5: 8}


def tiff(order, own, details=(), gps=(), loop=False):
    """A TIFF block from (tag, type, values) entries."""
    folders = [list(own), list(details), list(gps)]
    if details:
        folders[0].append((exif.DETAILS, 4, "details"))
    if gps:
        folders[0].append((exif.GPS, 4, "gps"))
    at, places = 8, {}
    for name, entries in zip(("own", "details", "gps"), folders, strict=True):
        places[name] = at
        at += 2 + 12 * len(entries) + 4
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    body, far = b"", b""
    for entries in folders:
        body += struct.pack(order + "H", len(entries))
        for tag, kind, values in sorted(entries, key=lambda e: e[0]):
            if isinstance(values, str) and kind == 4:
                data, n = struct.pack(order + "I", 8 if loop else places[values]), 1
            elif kind == 2:
                data = values.encode() + b"\0"
                n = len(data)
            elif kind == 5:
                data, n = b"".join(struct.pack(order + "II", *v) for v in values), len(values)
            else:
                data, n = b"".join(struct.pack(order + {3: "H", 4: "I"}[kind], v) for v in values), len(values)
            if len(data) > 4:
                data, far = struct.pack(order + "I", at + len(far)), far + data
            body += struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0")
        body += b"\0" * 4
    return head + body + far


OWN = [(exif.MAKE, 2, "Makers & Co"), (exif.MODEL, 2, "X1"), (exif.ORIENTATION, 3, [6]), (exif.CHANGED, 2, "2020:01:02 03:04:05")]
DETAILS = [(exif.TAKEN, 2, "2019:05:06 07:08:09"), (exif.ZONE, 2, "+02:00"), (exif.EXPOSURE, 5, [(1, 250)]), (exif.APERTURE, 5, [(28, 10)]), (exif.SENSITIVITY, 3, [400]), (exif.FOCAL, 5, [(50, 1)]), (exif.WIDTH, 4, [4000]), (exif.HEIGHT, 3, [3000])]
PLACE = [(exif.LAT_REF, 2, "S"), (exif.LAT, 5, [(33, 1), (30, 1), (0, 1)]), (exif.LON_REF, 2, "E"), (exif.LON, 5, [(151, 1), (0, 1), (36, 1)])]
WHOLE = ("Makers & Co", "X1", 6, "2019:05:06 07:08:09", "+02:00", 0.004, 2.8, 400, 50.0, 4000, 3000, -33.5, 151.01)


def jpeg(block):
    other = b"\xff\xe0" + struct.pack(">H", 7) + b"JFIF\0"
    return b"\xff\xd8" + other + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\2pixels"


@pytest.mark.parametrize("order", ["<", ">"])
def test_camera_time_and_place(order):
    block = tiff(order, OWN, DETAILS, PLACE)
    assert exif.facts(block) == pytest.approx(WHOLE) and exif.facts(jpeg(block)) == pytest.approx(WHOLE)
    assert exif.facts(tiff(order, OWN))[:4] == ("Makers & Co", "X1", 6, "2020:01:02 03:04:05")


def test_damage_gives_nulls():
    none = (None,) * len(WHOLE)
    for bad in (None, b"", b"II*\0", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\0Exif\0\0", b"II*\0\xff\xff\xff\xff", b"text", b"\xff\xd8\xff\xda\0\2"):
        assert exif.facts(bad) == none
    looping = exif.facts(tiff("<", OWN, DETAILS, PLACE, loop=True))
    assert looping[:3] == ("Makers & Co", "X1", 6) and looping[4:] == none[4:]
    block = tiff(">", OWN, DETAILS, PLACE)
    for cut in range(len(block)):  # whatever is left, nothing wrong is told
        assert all(got in (None, want) or got == "2020:01:02 03:04:05" for got, want in zip(exif.facts(block[:cut]), WHOLE, strict=True))
    zero = exif.facts(tiff("<", [], [(exif.EXPOSURE, 5, [(1, 0)])], [(exif.LAT_REF, 2, "N"), (exif.LAT, 5, [(91, 1), (0, 1), (0, 1)])]))
    assert zero == none
    rng = np.random.default_rng(0)
    for _ in range(500):
        noise = bytearray(block)
        for i in rng.integers(0, len(block), 6):
            noise[i] = rng.integers(0, 256)
        exif.facts(bytes(noise))


def test_pictures_in_spark(spark):
    rows = [(1, bytearray(jpeg(tiff("<", OWN, DETAILS, PLACE)))), (2, None), (3, bytearray(b"junk"))]
    got = {r.k: tuple(r)[1:] for r in exif.picture_facts(spark.createDataFrame(rows, "k int, content binary"), "content", "k").collect()}
    assert got[1] == pytest.approx(WHOLE) and got[2] == got[3] == (None,) * len(WHOLE)


def plant(root: Path):
    for name, size in {"a.jpg": 1, "b/c.JPG": 2, "b/note.txt": 3, "b/d/e.jpg": 4, "shut/x.jpg": 5, "shut/deep/y.jpg": 6, "shut/open/z.jpg": 7, ".trash/t.jpg": 8, "b/.trash/u.jpg": 9}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    os.symlink(root, root / "b" / "back")  # a loop
    os.symlink(root / "b", root / "again")  # seen under its own name
    os.symlink(root / "gone", root / "b" / "gone.jpg")


def test_walk_prunes_while_it_lists(tmp_path):
    root = tmp_path / "in"
    plant(root)
    outside = tmp_path / "out"
    (outside / "sub").mkdir(parents=True)
    (outside / "sub" / "o.jpg").write_bytes(b"1")
    os.symlink(outside, outside / "sub" / "self")
    os.symlink(outside, root / "linked")
    seen = []

    def listing(folder):
        seen.append(os.path.relpath(folder, root))
        return os.scandir(folder)

    r = str(root)
    rules = W.Rules((".trash",), (f"{r}/shut",), (f"{r}/shut/open",), (".jpg",))
    stat = os.stat(r)
    rows = list(W.walk(r, r, [r], frozenset({(stat.st_dev, stat.st_ino)}), rules, listing=listing))
    assert sorted(os.path.relpath(x[0], r) for x in rows) == ["a.jpg", "b/c.JPG", "b/d/e.jpg", "linked/sub/o.jpg", "shut/open/z.jpg"]
    assert sorted(seen) == [".", "b", "b/d", "linked", "linked/sub", "shut", "shut/open"]  # neither trash nor shut/deep nor a loop was listed


def test_tree_source(spark, tmp_path):
    root = tmp_path / "in"
    plant(root)
    rules = W.Rules((".trash",), (f"{root}/shut",), (), (".jpg",))
    for levels in (0, 1, 2):
        df = W.tree(spark, [str(root)], rules, levels)
        assert sorted((os.path.relpath(r.path, root), r.size) for r in df.collect()) == [("a.jpg", 1), ("b/c.JPG", 2), ("b/d/e.jpg", 4)]
        assert df.rdd.getNumPartitions() == {0: 2, 1: 2, 2: 2}[levels]
    with pytest.raises(Exception, match="No such file|missing"):
        W.tree(spark, [str(root / "missing")]).collect()
    assert W.tree(spark, [str(root)]).where("error IS NOT NULL").count() == 0


def test_a_detector_is_made_once_a_worker(spark, tmp_path):
    class detectors_in:
        """A function that makes the detector and leaves its file in a folder; equal ones are one to the cache."""

        def __init__(self, folder):
            self.folder = folder

        def __hash__(self):
            return hash(self.folder)

        def __eq__(self, other):
            return getattr(other, "folder", None) == self.folder

        def __call__(self):
            import uuid

            with open(f"{self.folder}/made-{os.getpid()}-{uuid.uuid4().hex}", "w"):
                pass
            return lambda frame: ((m.start(), m.end(), "number", float(m.end() - m.start())) for m in re.finditer("[0-9]+", frame))

    rows = [(i, [f"a{i} 12 b", None, "no", "7 77 777"]) for i in range(400)] + [(900, []), (901, None), (902, ["none"])]
    df = spark.createDataFrame(rows, "id int, frames array<string>").repartition(4)
    make = detectors_in(str(tmp_path))
    got = detectors.detections(df, F.col("frames"), make).select("id", "frame", "number", "start", "stop", "label").collect()
    wanted = [(i, f, k, *m.span(), "number") for i, frames in rows for f, x in enumerate(frames or []) if x for k, m in enumerate(re.finditer("[0-9]+", x))]
    assert Counter(map(tuple, got)) == Counter(wanted)
    made = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert made and len(made) == len(set(made)) <= 16  # at most once in each process
    with pytest.raises(Exception, match="more than 2"):
        detectors.detections(df, F.col("frames"), make, most=2).collect()


SAMPLES = "file string, track long, ts double, quality double, core boolean, vector array<double>, person long"


def test_thresholds_are_the_safest_that_cover_most(spark):
    """Two people whose likeness is 0.6 in some files: thresholds below err there."""
    rng = np.random.default_rng(2)
    rows, names = [], [f"file {i}" for i in range(12)]
    for i, name in enumerate(names):
        a = np.eye(8)[0]
        b = 0.6 * a + 0.8 * np.eye(8)[1] if i % 2 else np.eye(8)[1]
        for who, centre in ((1, a), (2, b)):
            for t in range(3):
                for k in range(2):
                    v = centre + 0.15 * rng.normal(size=8) / np.sqrt(8)
                    rows.append((name, 10 * who + t, float(100 * who + 10 * t + k), 1.0, t < 2, (v / np.linalg.norm(v)).tolist(), who))
    df = spark.createDataFrame([*rows, ("nameless", 1, 0.0, 1.0, True, rows[0][5], None), (None, 1, 0.0, 1.0, True, rows[0][5], 1)], SAMPLES).repartition(3)
    got = {r.threshold: r for r in K.calibrated(df, "file", written).collect()}
    assert set(got) == set(K.GRID)
    import hashlib

    held = set(sorted(names, key=lambda n: hashlib.sha256(n.encode()).hexdigest())[::3])
    each = {(r.file, r.threshold): tuple(r)[2:] for r in K.trials(df.where("file <> 'nameless'"), "file").collect()}
    for threshold, r in got.items():
        for test, own in ((False, set(names) - held), (True, held)):
            sums = tuple(sum(each[f, threshold][k] for f in own) for k in range(4))
            assert sums == ((r.test_wrong, r.test_covered, r.test_excess, r.test_unresolved) if test else (r.wrong, r.covered, r.excess, r.unresolved))
    chosen = [r for r in got.values() if r.chosen]
    safe = [r for r in got.values() if r.wrong == 0 and r.covered > 0]
    best = min(safe, key=lambda r: (-r.covered, r.excess, -r.threshold))
    assert [r.threshold for r in chosen] == [best.threshold] and got[0.5].wrong > 0 and best.threshold > 0.6 and best.test_wrong == 0
    assert K.calibrated(df.where("person IS NULL"), "file", written).collect() == []


def test_judging_by_names():
    assert K.judged(np.array([0, 0, 0, 1, -1, 1]), [5, 5, 6, 5, 5, None]) == (1, 4, 1, 1)
