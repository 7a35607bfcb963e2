import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np

from tessera.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, n int, part string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = text.encode().split()
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))


def brute(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    ids = defaultdict(list)
    for d, t, *_ in rows:
        if d is not None:
            ids[t or ""].append(d)
    docs = defaultdict(list)
    for d, t, s, *_ in rows:
        masks = (*fails(t or ""), d is not None and min(ids[t or ""]) < d)
        docs[s or ""].append((dict(zip("ABCDE", masks, strict=True)), d in good, d in toxic))
    out = set()
    for part, own in docs.items():
        walked, total = [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                failing = sum(x[0][f] for x in own)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                walked.append((part, order, step, len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)))
                total[f] += len(gone)
        out |= {(*r, total[r[1][r[2] - 1]]) for r in walked}
    return out


def test_against_walking_all_orders(spark):
    rng = np.random.default_rng(3)
    pool = []
    for _ in range(25):
        n = int(rng.choice([0, 3, 150, 250]))
        words = rng.choice([f"w{i}" for i in range(int(rng.choice([20, 4000])))], n) if n else []
        pool.append(" \n".join(w.upper() if rng.random() < rng.choice([0, 0.3]) else w for w in words) + str(rng.choice(["", "|", " $"])))
    rows = [(int(i), str(rng.choice(pool)), str(rng.choice(["s", "t", "hot"])), 1, "clash") for i in rng.permutation(150)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], "s", 1, "x"), (None, rows[3][1], "t", 1, "x"), (None, rows[3][1], None, 1, "x"), (7000, None, None, 1, None), (7001, "", "", 1, None), (-5, pool[0], "s", 1, "")]
    rows.append((9000, "word " * 20000 + "#", "long", 1, None))
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 150, 2)] + [(0, None, 1), (2, 1, None), (None, 1, 1), (999999, 1, 1)]
    got = A.filter_interactions(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *A.COUNTS]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, labels)


def test_hot_copies(spark):
    rows = [(i, "same text", "hot", 1, None) for i in range(3000)]
    got = {(r.filter_order, r.step): r for r in A.filter_interactions(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()}
    assert got["EABCD", 1].removed == 2999 and got["AEBCD", 1].removed == 3000 and got["AEBCD", 2].redundant == 2999
    assert (got["AEBCD", 1].shapley, got["AEBCD", 2].shapley) == (120 + 2999 * 60, 2999 * 60)


def test_fewer_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 3, 4, 2, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in A.audit(counts, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 2, 2, 1, 8), ("XY", 2): (5, 0, 4, 0, 0, 0, 4), ("YX", 1): (7, 4, 0, 0, 2, 0, 4), ("YX", 2): (5, 2, 4, 2, 0, 1, 8)}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = A.filter_interactions(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    wanted = c.execute(A.audit_sql())
    assert [d[0] for d in wanted.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_empty(spark):
    assert A.filter_interactions(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []
