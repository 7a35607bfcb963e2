import math
import zlib
from collections import Counter

import numpy as np

from tessera.llm import brown as B

SCHEMA = "doc_id long, text string, score string, n_tokens int"


def parts_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.encode().split(), "end"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base(rows):
    c = Counter(t for d, text in rows if not held(d) for t in parts_of(text))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(t := parts_of(text)), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, text in rows]


def agrees(got, rows):
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    a = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    b = sorted(base(rows), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9, abs_tol=1e-9)


def test_on_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = B.score_documents(docs).collect()
    agrees(got, rows)
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 30, p=np.r_[np.full(20, 0.04), np.full(40, 0.005)]))) for i in range(60)]
    model, counts, _ = B.fit(spark.createDataFrame(rows, "doc_id long, text string"), core=15, classes=4, head=30, least=3)
    known = {r.word.encode(): r.n for r in counts.collect()}
    rest = model.of[-1]
    for before in range(len(model.transition)):
        total = 0.0
        for word, n in known.items():
            i = model.vocabulary.index.get(word)
            if i is None:
                total += 10 ** model.transition[before, rest] * (n - model.discount) / (model.rest_tokens + 1)
            else:
                total += 10 ** (model.transition[before, model.of[i]] + model.emission[i])
        total += 10 ** model.transition[before, rest] * model.unseen
        empty = set(range(len(model.transition))) - {rest} - set(model.of[:-1].tolist())
        total += sum(10 ** model.transition[before, c] for c in empty)  # classes without words
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    pairs = np.zeros((21, 21), np.int64)
    for a in range(20):
        for b in range(20):
            if a % 2 != b % 2:
                pairs[a, b] = rng.integers(5, 20)
    of = B.exchange(pairs[:, :], 20, 2)
    assert len(set(of[0:20:2])) == 1 and len(set(of[1:20:2])) == 1 and of[0] != of[1]


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(4)
    words, classes = 30, 5
    pairs = rng.integers(0, 4, (words, words))
    of = np.r_[rng.integers(0, classes, words - 6), np.full(4, classes), np.full(2, classes + 1)]  # 4 to be inserted, 2 outside
    group = lambda of: np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(classes + 2)] for a in range(classes + 2)])
    of_class = np.eye(classes + 2, dtype=int)[of]
    apart = pairs - np.diag(np.diag(pairs))
    best, gain = B.best_classes((apart.T @ of_class), apart @ of_class, np.diag(pairs), of, group(of), classes)

    def value(of):  # the size of a class as the mean of what stands before and after
        grouped = group(of)
        size = (grouped.sum(axis=0) + grouped.sum(axis=1)) / 2
        return B._xlogx(grouped).sum() - 2 * B._xlogx(size[:classes]).sum()

    for w in range(words - 6):
        changed = [value(np.r_[of[:w], c, of[w + 1 :]]) - value(of) for c in range(classes)]
        assert math.isclose(max(changed), gain[w], abs_tol=1e-6) and math.isclose(changed[best[w]], max(changed), abs_tol=1e-6)
    for w in range(words - 6, words - 2):
        assert best[w] == np.argmax([value(np.r_[of[:w], c, of[w + 1 :]]) for c in range(classes)])


def test_rare_words_join_the_class_of_their_contexts(spark):
    rng = np.random.default_rng(6)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]
    weights = np.array([40.0] * 8 + [1.0] * 32) / 352
    texts = [" ".join(str(rng.choice(kinds[i % 3], p=weights)) for i in range(60)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, _, _ = B.fit(docs, core=25, classes=4, head=1000, least=3)
    of = {w.decode(): model.of[i] for w, i in model.vocabulary.index.items()}
    homes = [Counter(c for w, c in of.items() if w[0] == k) for k in "abc"]
    assert sum(h.most_common(1)[0][1] for h in homes) >= 0.95 * sum(sum(h.values()) for h in homes)
    assert len({h.most_common(1)[0][0] for h in homes}) == 3


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Ab aB É \x1c"), (3, "ab " * 20000), (3, "other text"), (4, "ab c"), (4, "ab c"), (19, "never seen")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    agrees(B.score_documents(docs).collect(), rows)
    assert B.score_documents(docs.limit(0)).collect() == []
    only = next(i for i in range(100) if held(i))
    agrees(B.score_documents(spark.createDataFrame([(only, "a b", "x", 1)], SCHEMA)).collect(), [(only, "a b")])
