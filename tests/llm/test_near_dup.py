from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import near_dup as N

SCHEMA = "doc_id long, text string, version string, class_id string"


def brute_classes(rows):
    """Classes of (doc_id, text) rows by comparing all pairs that share a shingle."""
    bags = []
    for _, text in rows:
        words = (text or "").encode().split()
        k = min(5, len(words))
        bags.append(Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter())
    at, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, bag in enumerate(bags):
        for j in {j for s in bag for j in at[s]}:
            both = sum((bag & bags[j]).values())
            if both / (sum(bag.values()) + sum(bags[j].values()) - both) >= 0.8:
                root[find(i)] = find(j)
        for s in bag:
            at[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((doc_id, least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(80):
        pool = rng.integers(0, 2**63, 120).astype(np.uint64)
        a = (np.sort(pool[:80]), rng.integers(1, 5, 80))
        b = (np.sort(pool[20:120]), rng.integers(1, 9, 100))
        off.append((N.signature(*a, 128) == N.signature(*b, 128)).mean() - N.overlap(a, b))
    assert abs(np.mean(off)) < 4 * np.std(off) / np.sqrt(len(off))


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(docs).collect())
    assert got == brute_classes(rows)


def test_edges_and_chains(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    chain = [" ".join(words[: 100 - i] + [f"x{j}" for j in range(i)]) for i in range(0, 30, 2)]  # neighbours alike, ends not
    odd = ["", None, " \t", "two words", "two words", "two  words", "a b c d e", "a b c d e a b c d e", "b a", "long " * 40000]
    rows = [(100 + i, t, "v", "c") for i, t in enumerate(chain + odd)] + [(100, chain[0], "v", "c"), (100, "another text of this same id stands here", "v", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(docs).collect())
    blank = len(chain)
    wanted = brute_classes([(d, t) for d, t, *_ in rows])
    assert got == wanted
    assert {c for d, c in got if d < 100 + blank} == {100}
    kept = Counter(r.doc_id for r in N.keep_one(docs).collect())
    assert kept[100] == 2 and all(kept[100 + blank + i] == 1 for i in range(3))
    assert N.keep_one(docs).columns == docs.columns
    assert N.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_excess_counts_what_lies_beyond():
    rng = np.random.default_rng(9)
    for _ in range(50):
        h, x, y = ((np.unique(rng.integers(0, 30, 20)).astype(np.uint64)) for _ in range(3))
        h, x, y = ((k, rng.integers(1, 4, len(k))) for k in (h, x, y))
        counts = [dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in (h, x, y)]
        beyond = sum(max(0, min(counts[1].get(s, 0), counts[2].get(s, 0)) - counts[0].get(s, 0)) for s in range(30))
        assert len(set(N.excess(x, h).tolist()) & set(N.excess(y, h).tolist())) == beyond


def test_a_family_without_its_origin(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for j in rng.choice(150, rng.integers(2, 9), replace=False):
            words[j] = f"e{rng.integers(0, 3)}"
        if i % 5 == 0:
            words = words[: rng.integers(120, 150)]
        texts.append(" ".join(words))
    rows = [(int(i), t, "v", "c") for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_classes([(d, t) for d, t, *_ in rows])


def test_null_ids_keep_their_links(spark):
    from tessera.llm.near_dup import near_duplicate_classes

    words = [f"w{i}" for i in range(100)]
    near, other = " ".join([*words[:99], "x"]), " ".join(f"v{i}" for i in range(100))
    rows = [(1, near), (5, " ".join(words)), (None, " ".join(words)), (9, other), (None, other[:-3] + "y")]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 1), (0, 9), (1, 1), (5, 1), (9, 9)]


def test_parts_of_one_long_document(spark):
    """Members that lie in their head, unlike it and like one another."""
    rng = np.random.default_rng(21)
    whole = [f"b{i}" for i in range(200)]
    texts = [" ".join(whole)]
    for i in range(60):
        start = int(rng.integers(0, 80))
        texts.append(" ".join(whole[start : start + int(rng.integers(100, 120))]))
    rows = [(i, t, "v", "c") for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_classes([(d, t) for d, t, *_ in rows])


def test_counts_beyond_a_million_are_unbiased():
    keys = np.array([1, 2], np.uint64)
    a, b = (keys, np.array([3_000_000, 500_000])), (keys, np.array([2_000_000, 900_000]))
    same = np.mean([(N.signature(a[0] + np.uint64(7 * i), a[1], 96) == N.signature(b[0] + np.uint64(7 * i), b[1], 96)).mean() for i in range(12)])
    assert abs(same - N.overlap(a, b)) < 0.06


@pytest.mark.parametrize(("hot", "sent"), [(3, 1 << 25), (3, 4000), (10**6, 0)])
def test_a_very_large_family(spark, monkeypatch, hot, sent):
    """Near copies of one text, with its bag broadcast, partly broadcast and joined, and some other families."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "SENT", sent)
    rng = np.random.default_rng(8)
    rows = []
    for family, n in enumerate((300, 30, 12)):
        base = [f"f{family}w{i}" for i in rng.integers(0, 500, 150)]
        for _ in range(n):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 4)):
                words[at] = f"x{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(6)
    assert Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(docs).collect()) == brute_classes(rows)
