import math

import numpy as np
import pytest

from tessera.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    vectors = np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = (vectors * v).sum(axis=1)
            other = ids != i
            best = np.lexsort((ids[other], -scores[other]))[:k]
            out[i] = list(zip(ids[other][best].tolist(), scores[other][best].tolist(), strict=True))
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(wanted, got):
    return np.mean([len({i for i, _ in wanted[q]} & {i for i, _ in got[q]}) / len(wanted[q]) for q in wanted])


@pytest.mark.parametrize(("sf", "options"), [("0.001", {}), ("0.01", {}), ("0.1", {}), ("0.1", {"block": 300, "query_block": 30})])
def test_recall_on_the_test_tables(spark, sf, options):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    wanted, got = brute(rows, 20, 20), found(N.nearest(df, **options))
    assert got.keys() == wanted.keys()
    assert recall(wanted, got) >= 0.9
    for q in list(wanted)[:20]:
        scores = dict(brute_scores(rows, q))
        assert len(got[q]) == 20 and all(scores[i] == s for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_near_neighbours_need_few_cells():
    """Where neighbours stand out a query reaches few cells, and few vectors of a block are verified."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((400, 32))
    vectors = np.repeat(centres, 40, axis=0) + 0.05 * rng.standard_normal((16000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    cells = N.Cells(rng.standard_normal((33, 6)), vectors[::10], 1.0)
    reached = np.mean([len(cells.reached(v, 0.997)) for v in vectors[::500]])
    assert reached < 32
    (index,) = N.ranges(np.arange(16000), vectors, rng.standard_normal((33, N.PROJECTIONS)))
    unit = N.first_window(vectors[::4], 20 / 16000) * N._spread(N.PROJECTIONS)
    for own in range(0, 16000, 1600):
        ids, _ = index.search(vectors[own], own, 20, unit, N._spread(N.PROJECTIONS), np.empty(0), -math.inf)
        assert len(ids) < 800


def brute_scores(rows, q):
    query = np.array(dict(rows)[q], np.float64)
    return [(i, float((np.array(v, np.float64) * query).sum())) for i, v in rows]


def test_edges(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0.5, "x") for i in range(90)]
    vectors += [(100 + i, vectors[3][1], 0.5, "x") for i in range(60)]  # copies: ties to the smaller id
    vectors += [(200, None, 0.5, "x"), (220, [0.0] * 8, 0.5, "x"), (240, [float("nan")] + [1.0] * 7, 0.5, "x"), (260, [None] + [1.0] * 7, 0.5, "x"), (280, [float("inf")] + [1.0] * 7, 0.5, "x"), (300, [], 0.5, "x"), (None, [1.0] * 8, 0.5, "x")]
    df = spark.createDataFrame(vectors, SCHEMA)
    got = found(N.nearest(df, block=64, query_block=3))
    wanted = brute([(i, v) for i, v, *_ in vectors], 20, 20)
    assert got.keys() == wanted.keys()
    assert recall(wanted, got) >= 0.9
    few = spark.createDataFrame(vectors[:5], SCHEMA)
    assert found(N.nearest(few)) == brute([(i, v) for i, v, *_ in vectors[:5]], 20, 20)
    assert N.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.nearest(df.where("vec_id >= 200")).count() == 0


def test_recall_on_uneven_norms(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    unit = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    rng = np.random.default_rng(5)
    lengths = np.exp(rng.normal(0, 0.5, len(unit)))
    for factors in (np.where(np.arange(len(unit)) == 7, 3.0, 1.0), lengths):
        rows = [(i, [float(x) for x in np.array(v) * f]) for (i, v), f in zip(unit, factors, strict=True)]
        wanted, got = brute(rows, 20, 50), found(N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50))
        assert got.keys() == wanted.keys()
        assert recall(wanted, got) >= 0.9
