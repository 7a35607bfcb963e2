import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, runs int"
ITEMS = "item_id long, text string, doc_id string"
QUESTION = "Anna has 12 apples and gives 5 kg of apples to Bob , then Anna counts the apples that are left over"


def test_copies_and_other_parameters(spark):
    filler = "some words that stand around the question and say nothing "
    swapped = QUESTION.replace("Anna", "Clara").replace("Bob", "David").replace("12", "31").replace("5 kg", "7 lbs")
    mixed = QUESTION.replace("Anna", "Clara", 1)  # the same name replaced once only
    rows = [
        (1, filler + QUESTION + ". " + filler, "x", 1), (2, filler + swapped, "x", 1), (3, filler + mixed, "x", 1), (4, filler * 30, "x", 1), (5, None, "x", 1), (6, "", "x", 1),
        (None, swapped, "x", 1), (1, filler + QUESTION + ". " + filler, "x", 1), (7, " ".join(QUESTION.split()[:9]), "x", 1), (8, filler * 40000 + QUESTION, "x", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(10, QUESTION, "x"), (11, None, "x"), (12, "short one", "x"), (10, QUESTION, "x"), (13, "five words stand alone here", "x")], ITEMS)
    got = {(r.doc_id, r.item_id): r.n_changed for r in D.contaminated_pairs(docs, items).collect()}
    assert got == {(1, 10): 0, (2, 10): 5, (None, 10): 5, (8, 10): 0}
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    saturated = {(r.doc_id, r.item_id) for r in D.contaminated_pairs(docs, items, max_cells=1).collect()}
    assert saturated == set(got)
    assert D.contaminated_pairs(docs.limit(0), items).collect() == [] and D.contaminated_pairs(docs, items.limit(0)).collect() == []


ITEM = "A train leaves Lisbon at 9 in the morning with 40 euros of coal and 5 kg of bread , and Maria pays for all of it in cash before the train stops"


@pytest.mark.parametrize(
    ("changes", "found"),
    [
        ([], True),
        ([("Lisbon", "New York")], True),
        ([("Lisbon", "New York"), ("Maria", "Anna Sofia Keller")], True),
        ([("9 in", "twenty five in"), ("40", "sixty-two")], True),
        ([("5 kg", "5kg"), ("40 euros", "40euros")], True),
        ([("40", "1 200"), ("5", "3 000")], True),
        ([("Lisbon", "USA")], True),
        ([("Lisbon", "lisbon")], True),
        ([("Lisbon", "Porto"), ("Maria", "maria")], True),
        ([(" ,", ",")], True),
        ([("leaves", "enters"), ("coal", "wood"), ("bread", "salt"), ("pays", "asks"), ("cash", "coins")], False),
    ],
)
def test_variants_of_one_item(spark, changes, found):
    text = ITEM
    for old, new in changes:
        text = text.replace(old, new)
    filler = "some words that stand around the question and say nothing "
    docs = spark.createDataFrame([(1, filler + text + ". " + filler), (2, filler * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = D.contaminated_pairs(docs, items).drop("version").collect()
    assert [(r.doc_id, r.item_id) for r in got] == ([(1, 7)] if found else [])
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    assert sorted(con.execute(f"SELECT doc_id, item_id, n_runs, item_runs, n_slots, n_changed FROM ({D.contaminated_sql()})").fetchall()) == sorted(tuple(r) for r in got)


def test_quick_patterns_match_as_the_plain_ones(spark):
    words = "six sixty sixteen Six-teen twenty-five TWENTY-one, seventy. (eight) eighth ten- -ten one-two-x one--two nine<n Anna \"Bob New-York Élan ÉLAN ſix straße x-Anna 'Anna' Anna-b 5kg 7 KM. 1 200 1,200.5 {a}_[b] ### --Paris- 日本 ١٢ é̀ A a\u2028b \u00a0 K".split(" ")
    texts = [" ".join(words[(i * step) % len(words)] for i in range(len(words))) for step in range(1, len(words))] + ["", " ", "  one  ", "one", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("m"))
    for pattern, by in [s for s in D.MARKS + D.BARE if s[1] != "_"]:
        quick = D._steps(F.col("m"), [(pattern, by)])
        assert df.where(quick != F.regexp_replace("m", pattern, by)).count() == 0
        df = df.select(quick.alias("m"))
    assert len(D.QUICK) == 3 and set(D.QUICK) <= {p for p, _ in D.MARKS + D.BARE}


def test_few_runs_are_met_falsely(spark):
    hashes, cells = spark.range(4000).select(F.xxhash64("id").alias("hash")), 1 << 17  # as many cells as contaminated_pairs takes for them
    marks = D.marked_cells(hashes, cells)
    assert hashes.where(D.may_be_met(F.col("hash"), cells, marks)).count() == 4000
    others = spark.range(10000, 210000).select(F.xxhash64("id").alias("hash"))
    assert others.where(D.may_be_met(F.col("hash"), cells, marks)).count() < 2000  # with one cell a run: some 6,000


def test_plans_stay_small_and_no_run_is_missed(spark):
    """The table of a benchmark's runs stands in every plan that the driver writes out: 200 items as long as those of sf0.1."""
    word = lambda i, j: "w" + f"{i * 60 + j:05d}".translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  figures would fill slots
    rows = [(i, " ".join(word(i, j) for j in range(60)), "x", 1) for i in range(200)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([r[:3] for r in rows], ITEMS)
    pairs = D.contaminated_pairs(docs, items)
    assert len(pairs._jdf.queryExecution().executedPlan().toString()) < 500_000
    assert {(r.doc_id, r.item_id) for r in pairs.select("doc_id", "item_id").collect()} == {(i, i) for i in range(200)}
    hashes = spark.range(-3000, 3000).select(F.xxhash64("id").alias("hash"))
    marks = D.marked_cells(hashes.where("hash % 2 = 0"), 4096)
    met = {r.hash for r in hashes.where(D.may_be_met(F.col("hash"), 4096, marks)).collect()}
    kept = {r.hash for r in hashes.collect() if r.hash % 2 == 0}
    assert max(marks) < 128 and kept <= met and len(met - kept) < 300
