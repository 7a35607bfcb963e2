import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, version string, n int"


def brute(rows, width):
    first = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if doc_id is not None:
                first[key] = min(doc_id, first.get(key, doc_id))
    out = Counter()
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - width + 1):
            if doc_id is not None and first[tuple(words[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[(doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width", [4, 7, 50])
def test_against_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(S, "HOT", 20)  # a few hot keys, most are not
    rng = np.random.default_rng(width)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "\x1c", "a b", "Ω"]
    passages = [" ".join(rng.choice(vocabulary, rng.integers(width - 1, 3 * width))) for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary, rng.integers(1, 2 * width))) for _ in range(rng.integers(1, 6))]
        texts.append("\n\t ".join(parts))
    texts += ["", None, " ", "the " * 300, "the " * 170, texts[0], texts[0], "long " + " ".join(map(str, range(30000)))]
    rows = [(int(i), t, "x", 1) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [rows[0], (rows[1][0], texts[2], "x", 1), (None, texts[3], "x", 1), (None, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in S.dedup_report(docs, width, most_cells=1 << 19).collect())
    assert got == brute(rows, width)
    kept = S.dedup_texts(docs, width)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in kept.collect()) == Counter((d, h) for (d, _, _, h), n in got.items() for _ in range(n))


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 60, 40))) for _ in range(50)] * 2
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(7)
    bits = S.repeated_cells(docs, 10, 1 << 16, 2)
    for text in texts:
        assert S.estimated_repeated(S.anchors(S.H.words(text), 10), bits).all()
    fresh = S.anchors(S.H.words(" ".join(map(str, range(1000, 3000)))), 10)
    assert S.estimated_repeated(fresh, bits).mean() < 0.05


def test_the_sketch_follows_the_texts(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 500000) AS text")
    assert S.sketch_size(docs) == (1 << 21, 1) and S.sketch_size(docs, 1 << 18) == (1 << 18, 8)
    assert S.sketch_size(docs.limit(0)) == (S.LEAST_CELLS, 1)


def test_empty(spark):
    assert S.dedup_report(spark.createDataFrame([], SCHEMA)).collect() == []
