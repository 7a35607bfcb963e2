import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import cotraining as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, p_text int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = C.score_quality(docs, labels.where("doc_id % 4 <> 0"))
    assert scored.count() == docs.count()
    scored = scored.join(labels.where("doc_id % 4 = 0").withColumnRenamed("quality", "good"), "doc_id").toPandas()
    good, said = scored["good"].to_numpy() > 0, scored["keeps"].to_numpy()
    assert (good == said).mean() > 0.95
    order = np.argsort(scored["quality"].to_numpy())
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    auc = (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()
    assert auc > 0.95


def test_marks_of_one_view_teach_the_other():
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.5
    text = [np.unique(rng.integers(100, 130, 6) + (40 if good else 0)).astype(np.uint64) for good in y]
    meta = [np.array([1 if good ^ (rng.random() < 0.1) else 2], np.uint64) for good in y]
    known = np.zeros(600, bool)
    known[:60] = True
    scorer = C.co_train((text[:60], meta[:60]), y[:60], (text[60:], meta[60:]), np.arange(60) % 3 == 0)
    p = scorer.score(text[60:], meta[60:])[2]
    assert ((p > 0.5) == y[60:]).mean() > 0.95


def test_scores_are_those_of_the_written_model(spark):
    """Every row's scores from the model by plain sums over its features."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = C.view_table(docs)
    model = C.train(table, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert (model.weights[:2] >= 0).all()
    got = {r.doc_id: r for r in C.score_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
    for d in docs.collect():
        odds = []
        for view, found in ((model.text, C.text_features(d.text)), (model.meta, C.meta_features(d.source, d.lang, d.n_chars))):
            weights = dict(zip(view.features.tolist(), view.weights, strict=False))
            odds.append(view.slope * (view.weights[-1] + sum(weights.get(f, 0.0) for f in set(found.tolist()))) + view.intercept)
        z = model.weights[0] * odds[0] + model.weights[1] * odds[1] + model.weights[2]
        for value, wanted in ((got[d.doc_id].p_text, odds[0]), (got[d.doc_id].p_meta, odds[1]), (got[d.doc_id].quality, z)):
            assert math.isclose(value, 1 / (1 + math.exp(-max(-35, min(35, wanted)))), rel_tol=1e-6, abs_tol=1e-9)
        assert got[d.doc_id].keeps == (got[d.doc_id].quality >= 0.5)


def test_no_view_counts_against_itself():
    rng = np.random.default_rng(0)
    y = rng.random(500) < 0.5
    good = np.where(y, 2.0, -2.0) + rng.standard_normal(500)
    weights = C.combination(np.column_stack((good, -good + rng.standard_normal(500))), y)
    assert weights[0] > 0 and weights[1] == 0


def test_edges(spark):
    rows = [(i, f"good words stand here {i}" if i % 2 else f"junk ### $$$ {i}", "en", "a", 20, "x", 1) for i in range(80)]
    rows += [(100, None, None, None, None, "x", 1), (101, "", "", "", 0, "x", 1), (None, "good words", "en", "a", 10, "x", 1), (1, "good words stand here 1", "en", "a", 20, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = C.score_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(r.keeps == bool(r.doc_id % 2) for r in out if r.doc_id is not None and 60 <= r.doc_id < 80)
    assert all(r.keeps and r.quality == 0.5 for r in C.score_quality(docs, labels.where("quality = 1")).collect())
    assert C.score_quality(docs.limit(0), labels).collect() == []


def test_every_unlabelled_document_may_teach(spark):
    # Twelve of 2,000 unlabelled documents, far fewer than a share of 200 of them holds, come from a source of their own.
    good, junk = [f"good{i} " for i in range(12)], [f"junk{i} " for i in range(12)]
    rng = np.random.default_rng(3)
    text = lambda words, n: "".join(rng.choice(words, n, replace=False))
    rows = [(i, text(good if i % 2 else junk, 5), "en", "ab"[i % 2], 40) for i in range(200)]
    rows += [(1000 + i, text(good, 3) + text(junk, 2), "en", "ab"[i % 2], 40) for i in range(1988)]
    rows += [(5000 + i, text(good, 12), "en", "rare", 40) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    scored = {r.doc_id: r.p_meta for r in C.score_quality(docs, labels, pool=200).collect()}
    assert len(scored) == len(rows) and min(scored[5000 + i] for i in range(12)) > 0.7


def test_a_labelled_id_on_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    sent = []
    collect = type(spark.range(1)).toPandas
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: sent.append(out := collect(self)) or out)
    rows = [(i, f"good words stand here {i}" if i % 2 else f"junk ### $$$ {i}", "en", "a", 20, "x", 1) for i in range(80)] + [(3, f"good words again {i % 50}", "en", "a", 20, "x", 1) for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    C.score_quality(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert sent and max(map(len, sent)) <= 120


def test_marks_are_chosen_task_by_task(spark):
    """The plan ranks within each task first, so that no task gets all sure documents."""
    table = spark.createDataFrame([(i, i, [1, 2], [3]) for i in range(100)], "doc_id long, hash long, text array<int>, meta array<int>")
    plans = []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    view = C.View(np.array([1], np.uint32), np.array([9.0, 0.0]))
    collect = type(table).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(table), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
        marks = C.Distributed(table, labels, 100).best([view, view], [set(), set()], {True: 7, False: 3}, 0.9)
    assert any("WindowGroupLimit" in p for p in plans) and [len(m) for m in marks] == [7, 0]


def test_features_are_scored_in_small_parts(spark, monkeypatch):
    frame, given = type(spark.range(1)), []
    map_in_arrow = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: given.append(f) or map_in_arrow(self, f, schema))
    view = C.View(np.array([1], np.uint32), np.array([9.0, 0.0]))
    table = spark.range(3000).selectExpr("id AS doc_id", "id AS hash", "array(1, 2) AS text", "array(3) AS meta")
    C.Distributed(table, spark.createDataFrame([], "doc_id long, quality int"), 100).best([view, view], [set(), set()], {True: 7, False: 3}, 0.9)
    monkeypatch.setattr(C, "train", lambda *_: C.Scorer(view, view, np.array([1.0, 1.0, 0.0])))
    C.score_quality(spark.range(9).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang", "'a' AS source", "10L AS n_chars"), table)
    ids, lists = pa.array(range(3000)), pa.array([[1, 2]] * 3000, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, lists, lists], ["doc_id", "key", "hash", "text", "meta"])
    for run in (given[0], given[-1]):
        rows = [b.num_rows for b in run(iter([batch]))]
        assert sum(rows) == 3000 and max(rows) <= 256
