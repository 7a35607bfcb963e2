import math

import numpy as np

from tessera.llm import linear as L
from tessera.llm import toxicity as T

SCHEMA = "doc_id long, text string, p_toxic string, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    scored = T.score_toxicity(docs.join(held.select("doc_id"), "doc_id"), labels.where("doc_id % 4 <> 0"))
    assert scored.count() == held.count()
    # the sample is taken from the scored documents' table: score again with all documents at hand
    scored = T.score_toxicity(docs, labels.where("doc_id % 4 <> 0")).join(held, "doc_id").toPandas()
    toxic, said = scored["toxic"].to_numpy() > 0, scored["is_toxic"].to_numpy()
    assert (toxic & said).sum() / toxic.sum() > 0.8 and (toxic & said).sum() / said.sum() > 0.85


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    base = rng.random(400) < 0.5
    rows = [np.unique(np.r_[rng.integers(10, 60, 5), [1] if b else []]).astype(np.uint64) for b in base]
    marks = {"first": base, "second": base ^ (rng.random(400) < 0.05)}
    chain = T.fit_chain(rows, marks, np.arange(400) % 4, 40)
    link = chain.links[1]
    assert len(link.weights) == len(link.features) + 2 and link.weights[-2] > 0
    said = np.array([chain.score(r)[-1] > 0.5 for r in rows])
    assert (said == marks["second"]).mean() > 0.9


def test_scores_are_those_of_the_chain(spark):
    """Every row's probabilities from the links by plain sums; each link is fed the earlier ones' probabilities."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = T.train(docs, labels)
    got = {r.doc_id: r for r in T.score_toxicity(docs, labels).collect()}
    for d in docs.collect():
        found, chances, z = set(T.text_features(d.text).tolist()), [], 0.0
        for link in chain.links:
            own = dict(zip(link.features.tolist(), link.weights, strict=False))
            z = link.weights[-1] + sum(own.get(f, 0.0) for f in found) + sum(w * p for w, p in zip(link.weights[len(own) : -1], chances, strict=True))
            chances.append(1 / (1 + math.exp(-z)))
        chances[-1] = 1 / (1 + math.exp(-(chain.slope * z + chain.intercept)))
        for link, p in zip(chain.links, chances, strict=True):
            assert math.isclose(got[d.doc_id][f"p_{link.name}"], p, rel_tol=1e-6, abs_tol=1e-9)
        assert got[d.doc_id].is_toxic == (got[d.doc_id].p_toxic >= 0.5)


def test_training_probabilities_come_from_other_folds():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.uint32) for _ in range(120)]
    first = np.array([5 in r for r in rows])
    second, fold = first ^ (rng.random(120) < 0.1), np.arange(120) % 3
    chain = T.fit_chain(rows, {"first": first, "second": second}, fold, 20)
    earlier = np.zeros(120)
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        features, w = T._fit([rows[i] for i in train], first[train], np.zeros((len(train), 0)), 20)
        earlier[test] = [1 / (1 + math.exp(-(w[-1] + sum(x for f, x in zip(features, w, strict=False) if f in rows[i])))) for i in test]
    features, w = T._fit(rows, second, earlier[:, None], 20)
    assert (chain.links[1].features == features).all() and np.allclose(chain.links[1].weights, w, atol=1e-4)


def test_edges(spark):
    rows = [(i, f"you idiot number {i}" if i % 2 else f"a kind word {i}", "x", 3) for i in range(60)] + [(70, None, "x", 3), (71, "", "x", 3), (None, "you idiot", "x", 3), (1, "a kind word", "x", 3), (72, "idiot " * 50000, "x", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (3, 1), (999, 1)], "doc_id long, toxic int")
    out = T.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and {r.is_toxic for r in out if r.doc_id == 72 or r.doc_id is None} == {True}
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.is_toxic for r in out)
    assert not any(r.is_toxic for r in T.score_toxicity(docs, labels.where("toxic = 0")).collect())
    assert T.score_toxicity(docs.limit(0), labels).collect() == []


def test_logistic_recovers_a_line():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 3))
    y = rng.random(4000) < L.sigmoid(x @ np.array([1.0, -2.0, 0.0]) + 0.5)
    assert np.allclose(L.fit_logistic(x, y, 0.01, 800), [1, -2, 0, 0.5], atol=0.2)
