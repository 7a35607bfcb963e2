import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periodic_runs as P
from tessera.llm.queries import op12_main_lorentz_runs

SCHEMA = "doc_id long, text string, runs string, n int"


def brute(x, least=P.LEAST, times=P.TIMES):
    """Every period, every maximal stretch of words equal at that distance; an interval keeps its smallest period."""
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests)


def test_z_function():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 2, rng.integers(0, 30)).tolist()
        z = P.z_function(x)
        assert z[1:] == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (4, 2), (2, 2), (9, 4)])
def test_runs_equal_brute_force(least, times):
    rng = np.random.default_rng(least * times)
    for _ in range(400):
        x: list[int] = []
        while len(x) < rng.integers(1, 200):
            word = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 14)).tolist()
            x += word * int(rng.integers(1, 9)) + word[: rng.integers(0, len(word) + 1)] if rng.random() < 0.6 else word
        assert P.runs(x, least, times) == brute(x, least, times)


def test_plain_shapes():
    assert P.runs([7] * 24) == [(0, 24, 1)] and P.runs([7] * 23) == []
    assert P.runs([1, 2] * 12 + [3] * 30) == [(0, 24, 2), (24, 30, 1)]
    assert P.runs(list(range(10)) * 3) == [(0, 30, 10)] and P.runs((list(range(10)) * 3)[:-1]) == []
    word = [0] * 30 + [1]
    assert P.runs(word * 4) == [(0, 124, 31), (0, 30, 1), (31, 30, 1), (62, 30, 1), (93, 30, 1)] or set(P.runs(word * 4)) == set(brute(word * 4))
    a, b = [0], [0, 1]  # a Fibonacci word, rich in short repetitions
    while len(b) < 3000:
        a, b = b, b + a
    assert P.runs(b, 6, 3) == brute(b, 6, 3)


def test_long_texts_stay_near_linear():
    rng = np.random.default_rng(5)
    for x in ([3] * 100_000, list(range(300)) * 300, rng.integers(0, 50, 100_000).tolist()):
        found = P.runs(x)
        assert found in ([], [(0, len(x), 1)], [(0, len(x), 300)])


def test_query_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocabulary = ["a", "B", "é", "\x1c", "x y", "Ω", "the"]
    texts = []
    for _ in range(300):
        word = " ".join(rng.choice(vocabulary, rng.integers(1, 9)))
        texts.append(" \t".join([" ".join(rng.choice(vocabulary, rng.integers(0, 40))), *[word] * int(rng.integers(1, 12)), "end\n"]))
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts, "", None, " \n", "w", "the " * 5000])]
    rows += [rows[0], rows[0], (rows[3][0], "other " * 40, "y", 2), (None, "again " * 30, "z", 3), (None, None, "z", 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_main_lorentz_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((report(d, t) for d, t, *_ in rows), key=repr)


def test_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op12_main_lorentz_runs(spark, sf).collect()}
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(got) == len(docs) and len(short) > 100
    for r in short:
        assert got[r.doc_id] == report(r.doc_id, r.text)


def test_empty(spark):
    assert P.run_report(P.periodic_runs(P.with_repeated_tails(spark.createDataFrame([], SCHEMA)))).collect() == []
