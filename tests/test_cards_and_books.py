"""Groups, cards, books and places on planted cases."""

import datetime
import difflib
import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import cards, ledger, merging
from tessera.plans import catalogue
from tessera.sources import places

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 5, 1)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_groups_against_a_plain_version(spark):
    random.seed(5)
    everyone = list(range(200))
    person = {f: random.randrange(5) for f in everyone if random.random() < 0.4}
    label = {f: random.choice([-1, 0, 1, 2]) for f in everyone if random.random() < 0.8}
    out, soft, drawn = ({f for f in everyone if random.random() < 0.2} for _ in range(3))
    wanted = set()
    for f in everyone:
        blurry = f in soft and f not in out
        if f in person and not blurry:
            wanted.add((f"person:{person[f]}", f))
        if f not in person and f not in out and f not in drawn and not blurry:
            wanted.add((f"auto:{label[f]}" if label.get(f, -1) != -1 else "noise", f))
        wanted |= {("blurry", f)} if blurry else set()
        wanted |= {("excluded", f)} if f in out else set()
    one = lambda items: spark.createDataFrame([(f,) for f in items], "face long")
    got = cards.face_groups(
        one([*everyone, 3, 3]),
        spark.createDataFrame(list(person.items()) + [(999, 1)], "face long, person long"),
        spark.createDataFrame([(f, x, 0.5) for f, x in label.items()] + [(None, 1, 0.9)], "face long, label long, confidence double"),
        one([*out, 998]), one(soft), one(drawn),
    )
    assert {(r["group"], r.face) for r in got.collect()} == wanted and got.count() == len(wanted)


def test_groups_of_nobody(spark):
    none = spark.createDataFrame([], "face long")
    groups = cards.face_groups(none, spark.createDataFrame([], "face long, person long"), spark.createDataFrame([], "face long, label long, confidence double"), none, none, none)
    made = cards.group_cards(groups, spark.createDataFrame([], "face long, blur double, size double"), spark.createDataFrame([], "group string, face long"))
    assert groups.count() == 0 and made.count() == 0


def test_a_pin_counts_while_its_face_is_in_the_group(spark):
    members = spark.createDataFrame([("person", "person:1", f, f / 10) for f in range(6)] + [("noise", "noise", f, 0.9) for f in (30, 20, 25)], "kind string, group string, face long, confidence double")
    quality = spark.createDataFrame([(f, 0.9 if f == 5 else 0.1, 160.0) for f in range(6)], "face long, blur double, size double")
    pins = lambda *rows: spark.createDataFrame(list(rows), "group string, face long")
    first = {r["group"]: r for r in cards.group_cards(members, quality, pins(("person:1", 2), ("noise", 77)), 3).collect()}
    assert first["person:1"].avatar == 2 and first["person:1"].pinned and first["person:1"].first == [5, 4, 3] and first["person:1"].n == 6
    assert not first["noise"].pinned and first["noise"].first == [20, 25, 30]
    again = {r["group"]: r for r in cards.group_cards(members, quality, pins(("person:1", 77))).collect()}
    assert again["person:1"].avatar == 4 and not again["person:1"].pinned


def test_labels_follow_the_active_model_and_what_people_said(spark):
    models = spark.createDataFrame([("v1", "clip", "candidate", 9), ("v2", "clip", "active", 5), ("v3", "other", "active", 7)], "version string, embedding string, status string, trained long")
    source = lambda e: tuple(cards.prediction_source(models, e).first())
    assert source("clip") == ("trained", "v2") and source("new") == ("zero_shot", "new")
    predictions = spark.createDataFrame(
        [("a", "cat", 0.91237, "trained", "v2"), ("a", "dog", 0.95, "trained", "v2"), ("a", "sea", 0.99, "trained", "v1"), ("a", "car", 0.5, "trained", "v2"), ("b", "dog", 0.1, "zero_shot", "clip")],
        "path string, label string, score double, origin string, version string",
    )
    said = spark.createDataFrame([("a", "dog", False), ("a", "snow", True), ("a", "car", True)], "path string, label string, value boolean")
    titles = spark.createDataFrame([("cat", "Cat"), ("car", "Car")], "label string, title string")
    got = cards.card_labels(predictions, said, cards.prediction_source(models, "clip"), titles).orderBy("path", "position")
    assert [(r.path, r.label, r.title, r.score, r.verified) for r in got.collect()] == [("a", "car", "Car", 0.5, True), ("a", "snow", "snow", 0.0, True), ("a", "cat", "Cat", 0.9124, False)]


def test_similar_lists_stay_full_however_many_copies_there_are(spark):
    rows = [(f"p{i:03d}", [1.0, i / 1000 if i else 0.5]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "path string, v array<double>")
    copies = spark.createDataFrame([(p, 1) for p, _ in rows[:90]] + [(p, 2) for p, _ in rows[90:95]], "path string, group long")
    seen = vectors.where("path <> 'p100'").select("path")
    probes = spark.createDataFrame([("p000",), ("p000",), ("p119",)], "path string")
    got = cards.similar(vectors, probes, copies, seen, 12).collect()
    ours = [r.path for r in sorted(got, key=lambda r: r.position) if r.probe == "p000"]
    assert ours == [f"p{i:03d}" for i in range(119, 106, -1) if i != 100][:12]
    assert sum(r.probe == "p119" for r in got) == 12 and all(r.path not in ("p119", "p100") for r in got if r.probe == "p119")


def test_chosen_cards_keep_their_order(spark):
    files = spark.createDataFrame([("a", 5, None, 7), ("b", 6, 1, 1), ("c", 7, 2, 2)], "path string, size long, width int, height int")
    visible = files.where("path <> 'b'").select("path")
    got = cards.chosen_cards(files, ["c", "a", "b", "c", "x"], visible).collect()
    assert [(r.path, r.size, r.width, r.height) for r in got] == [("c", 7, 2, 2), ("a", 5, 0, 7)]
    for wrong in ([], [str(i) for i in range(201)]):
        with pytest.raises(ValueError, match="choose"):
            cards.chosen_cards(files, wrong, visible)


def test_runs_are_counted_interrupted_and_completed(spark):
    schema = "roots array<string>, paths array<string>, features array<string>, at timestamp"
    start = lambda *rows: spark.createDataFrame([(list(r), list(p), list(f), DAY + datetime.timedelta(hours=h)) for r, p, f, h in rows], schema)
    runs = ledger.runs_started(spark.createDataFrame([], ledger.RUNS), start((["a"], [], ["x", "b"], 1)))
    assert (runs.first().status, runs.first()["last"], runs.first().done) == ("running", ["b", "x"], [])
    runs = ledger.runs_finished(runs, "completed")
    runs = ledger.runs_started(runs, start((["a"], [], ["c"], 2), (["n"], ["p"], ["c"], 3)))
    state = {r.roots[0]: r for r in runs.collect()}
    assert (state["a"].status, state["a"].runs, state["a"].done, state["a"]["last"], state["a"].first_run.hour) == ("interrupted", 2, ["b", "x"], ["c"], 1)
    assert (state["n"].status, state["n"].runs) == ("running", 1)
    failed = {r.roots[0]: r for r in ledger.runs_finished(runs, "failed").collect()}
    assert failed["n"].status == "failed" and failed["n"].done == [] and failed["a"].status == "interrupted"
    same = ledger.runs_started(runs, start())
    assert pairs(same, "roots", "runs", "status") == pairs(runs, "roots", "runs", "status")


def test_files_in_roots_against_a_plain_version(spark):
    random.seed(3)
    files = sorted({"nas:/" + "/".join(random.choices("abc", k=random.randrange(1, 4))) + f"/{i}.jpg" for i in range(60)} | {"pc-x:D:\\p\\q\\1.jpg", "pc-x:D:\\pq\\2.jpg", "/a/b/3.jpg"})
    runs = [(["nas:/a", "nas:/a/b/"], []), (["nas:/a/b", "nas:/"], []), (["pc-x:D:\\p"], []), ([], ["u", "v", "w"]), (["nas:/none"], []), ([files[0], "nas:/b"], []), (["nas:/a", "nas:/a"], ["z"])]
    got = ledger.files_in_roots(spark.createDataFrame(runs, "roots array<string>, paths array<string>"), spark.createDataFrame([(f,) for f in [*files, files[1], None]], "path string"))
    inside = lambda f, r: f == r or f.startswith(r.rstrip("/\\") + ("\\" if "\\" in r else "/"))
    wanted = sorted((r, p, sum(any(inside(f, x) for x in r) for f in files) if r else len(p)) for r, p in runs)
    assert pairs(got, "roots", "paths", "files") == wanted


def test_batches_expire_and_reserve(spark):
    day = lambda n: DAY - datetime.timedelta(days=n)
    batches = spark.createDataFrame([(1, "exported", day(8)), (2, "exported", day(6)), (3, "answered", day(30)), (4, "exported", day(7))], "id long, status string, created timestamp")
    after = ledger.expired(batches, DAY)
    assert pairs(after, "id", "status") == [(1, "expired"), (2, "exported"), (3, "answered"), (4, "exported")]
    gone = ledger.cancelled(after, spark.createDataFrame([(1,), (3,), (4,), (4,), (9,)], "id long"))
    assert pairs(gone, "id", "status") == [(1, "expired"), (2, "exported"), (3, "answered"), (4, "cancelled")]
    items = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "id long, path string")
    queue = spark.createDataFrame([(p, o) for o, p in enumerate("bcadefghijklmnopq")] + [("a", -1)], "path string, order long")
    assert [r.path for r in ledger.next_batch(queue, gone, items, 3).collect()] == ["a", "c", "d"]
    assert ledger.next_batch(queue, gone, items, 4).count() == 10  # not an allowed size


def test_one_version_is_active(spark):
    models = spark.createDataFrame([("v1", "clip", "active"), ("v2", "clip", "candidate"), ("v3", "other", "failed")], "version string, embedding string, status string")
    assert pairs(ledger.activated(models, "v2", "clip"), "version", "status") == [("v1", "candidate"), ("v2", "active"), ("v3", "failed")]
    for version in ("v9", "v3"):
        with pytest.raises(ValueError, match=version):
            ledger.activated(models, version, "clip")


def test_cleaning_takes_what_hangs_on_a_source(spark):
    tables = {
        "photos": spark.createDataFrame([("nas:/1", "m"), ("pc-x:/2", "m"), ("/3", "m"), ("D:\\4", "m"), (None, "m")], "path string, model string"),
        "thumbs": spark.createDataFrame([("nas:/1",), ("nasx:/1",), ("/3",)], "path string"),
        "faces": spark.createDataFrame([(1, "nas:/1"), (2, "pc-x:/2"), (3, "/3")], "face long, path string"),
        "apart": spark.createDataFrame([(2, 1), (2, 3), (None, 2)], "a long, b long"),
    }
    by_path = {"thumbs": ["thumbs", "not there"], "faces": ["faces"], "files": ["photos"]}
    rules = ({"apart": ("faces", "face", ["a", "b"])}, {"faces": ("photos", ["model"])})
    left, lost = ledger.cleaned(tables, "nas", {"faces"}, by_path, *rules)
    assert pairs(lost, "category", "table", "n") == [("faces", "faces", 1)]
    assert left["apart"].count() == 2 and left["thumbs"].count() == 3 and left["faces"].count() == 2
    assert {r.path for r in left["photos"].where("model IS NULL").collect()} == {"nas:/1"} and left["photos"].count() == 5
    left, lost = ledger.cleaned(tables, "", {"catalog"}, by_path, *rules)
    assert pairs(lost, "category", "n") == [("faces", 1), ("files", 2), ("thumbs", 1)] and left["photos"].count() == 3
    for source, what in (("Bad:", {"faces"}), ("nas", set()), ("nas", {"all"})):
        with pytest.raises(ValueError, match="."):
            ledger.cleaned(tables, source, what, by_path)


def test_rules_become_those_of_a_source(spark):
    text = "\n\n  D:\\x \r\nnas:/y\n\n\t*.tmp\n"
    df = spark.createDataFrame([(text, ["D:\\x", "nas:/y"]), ("", []), (None, None)], "rules string, roots array<string>")
    got = df.select(merging.keyed_rules(F.col("rules"), "pc-a").alias("rules"), merging.keyed_list(F.col("roots"), "pc-a").alias("roots")).collect()
    assert [tuple(r) for r in got] == [("pc-a:D:\\x\nnas:/y\n\npc-a:*.tmp", ["pc-a:D:\\x", "nas:/y"]), ("", []), (None, None)]


def plain_best(ascii_name, alternates):
    import re

    best, most = "", 0.0
    for name in (x.strip() for x in alternates.split(",")):
        if name and len(name) <= places.LONGEST and re.match(places.NAME, name):
            score = difflib.SequenceMatcher(None, "".join(places.LATIN.get(c, c) for c in name.lower()), ascii_name.lower()).ratio()
            if score > most:
                best, most = name, score
    return best if most >= places.LEAST else ascii_name


def test_place_names_against_a_plain_version(spark):
    got = {r.id: r.name for r in catalogue.QUERIES["place_names"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/part.parquet").where("p_size >= 5").collect()

    def spelt(text):
        import re

        return re.sub("[^а-яё -]", "ы", text.lower().translate(str.maketrans("abvgdeziklmnoprstuf", "абвгдезиклмнопрстуф")))

    wanted = {r.p_partkey: plain_best(r.p_name, ",".join([r.p_name, spelt(r.p_name[::-1]), spelt(r.p_name[:6]), spelt(r.p_name) + "I", spelt(r.p_name), spelt(r.p_brand)])) for r in rows}
    assert got == wanted and len(got) > 100 and any(c > "я" or "а" <= c for n in got.values() for c in n)


def test_gazetteer_from_archive_to_cells(spark, tmp_path):
    line = lambda i, ascii_name, others, kind, country, people, lat="55.75222", lon="37.61556": "\t".join([str(i), ascii_name, ascii_name, others, lat, lon, "P", kind, country, "", "", "", "", "", people, "", "", "", ""])
    lines = [
        line(1, "Kazan", "Kasan,Казань,Казан,Қазан", "PPLA", "RU", "1243500"),
        line(2, "Bulak", "Булак", "PPLX", "RU", "10"),
        line(3, "Moscow", "Мәскеу,Москва", "PPLC", "RU", ""),
        line(4, "Makhachkala", "МахIачхъала,Махачкала", "PPLA", "RU", "5", "-0.5", "-0.00001"),
        line(5, "Xyz \"Q\"", "Абвгд", "PPL", "ZZ", "7"),
        line("x", "Nowhere", "", "PPL", "RU", "1"),
        "cut\tline",
    ]
    with zipfile.ZipFile(tmp_path / "cities.zip", "w") as archive:
        archive.writestr("readme.md", "not a place\n")
        archive.writestr("cities.txt", "\n".join(lines) + "\n")
    listed = places.listed(places.zipped_lines(spark, str(tmp_path / "cities.zip")))
    titles = places.countries(spark.createDataFrame([("# comment",), ("",), ("RU\tRUS\t643\tRS\tRussia",), ("EG\tEGY\t818\tEG\tEgypt",)], "line string"))
    known = spark.createDataFrame([("Moscow", "RU", "Москва")], "ascii string, country string, title string")
    built = places.built(listed, known)
    assert pairs(built, "id", "name") == [(1, "Казань"), (3, "Москва"), (4, "Махачкала"), (5, 'Xyz "Q"')]
    assert {r.id: r.name for r in places.built(listed).collect()}[3] == plain_best("Moscow", "Мәскеу,Москва")
    places.write(built, titles, str(tmp_path / "out"))
    heads = [x for f in (tmp_path / "out").glob("*.gz") for x in gzip.open(f, "rt", encoding="utf-8").read().splitlines() if x.startswith("#")]
    assert heads == ["#countries\tEG=Egypt\tRU=Russia"]
    back = {r.city: r for r in places.read(spark, str(tmp_path / "out")).collect()}
    assert {c: (r.name, r.title, r.population) for c, r in back.items()} == {1: ("Казань", "Russia", 1243500), 3: ("Москва", "Russia", 0), 4: ("Махачкала", "Russia", 5), 5: ('Xyz "Q"', "ZZ", 7)}
    assert (back[4].cell_lat, back[4].cell_lon, back[1].lat, back[1].lon) == (-1, -1 if back[4].lon < 0 else 0, 55.7522, 37.6156)
