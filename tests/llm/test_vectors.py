"""Operators 4 and 10 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import impact, neighbours, vectors

KIND = "vec_id long, embedding array<float>, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], KIND)


def clustered(seed, n, d, groups):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d))
    x = centres[r.integers(groups, size=n)] + 0.3 * r.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact(ids, x, query, k):
    score = x @ x[query]
    order = [j for j in np.lexsort((ids, -score)) if j != query][:k]
    return [(int(ids[j]), score[j]) for j in order]


def check_top_k(spark, rows, k=5, scale=256, every=10):
    got = {}
    for r in impact.exact_top_k(frame(spark, rows), F.col("vec_id") % every == 0, k, scale).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = [(i, v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([np.floor(np.array(v, np.float32).astype(float) * scale) for _, v in ok]).astype(np.int64)
    for q in np.flatnonzero(ids % every == 0):
        want = exact(ids, x, q, k)
        assert [got[ids[q]][n + 1] for n in range(len(want))] == want
    assert len(got) == int((ids % every == 0).sum())


def test_top_k(spark):
    x = clustered(1, 600, 16, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2010, []), (2020, [float("nan")] * 16), (2030, [None] * 16), (2040, [float("inf")] * 16), (None, x[1].tolist()), (2050, [0.0] * 16)]
    check_top_k(spark, rows)
    check_top_k(spark, rows[:3])
    assert impact.exact_top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 150)
    check_top_k(spark, [(i, v.tolist()) for i, v in enumerate(clustered(2, 700, 8, 5))])


def test_stops_only_on_proof():
    """Large, small and sparse impacts: the index agrees with all products."""
    r = np.random.default_rng(5)
    for x in (r.integers(-3, 4, (400, 6)), r.integers(-40000, 40000, (400, 6)), np.where(r.random((400, 12)) < 0.1, r.integers(-200, 200, (400, 12)), 0), np.zeros((50, 4), np.int64), r.integers(-(2**40), 2**40, (200, 6))):
        x = x.astype(np.int64)
        ids = np.arange(len(x)) * 3
        got = impact.ImpactIndex(ids, x).search(ids[:40], x[:40], 5)
        for q in range(40):
            own = np.array([min(2**63 - 1, max(-(2**63) + 1, int(s))) for s in x.astype(object) @ x[q].astype(object)])
            order = [j for j in np.lexsort((ids, -own)) if j != q][:5]
            sel = got[0] == ids[q]
            assert got[1][sel].tolist() == ids[order].tolist() and got[2][sel].tolist() == own[order].tolist()


def table(name):
    import os

    import pyarrow.parquet as pq

    path = f"/root/testdata/sf0.1/{name}.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(path).to_pylist() if r["embedding"]]
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)


def test_queries_stop_before_the_end():
    """On the given vectors most queries stop by proof, with much of the postings unread."""
    ids, x = table("embeddings")
    whole = np.floor(x * 256).astype(np.int64)
    index = impact.ImpactIndex(ids, whole)
    asked = np.flatnonzero(ids % 50 == 0)
    index.search(ids[asked], whole[asked], 5)
    assert index.stopped >= 0.9 * index.asked and index.read <= 0.75 * index.postings


def test_less_than_half_is_verified():
    ids, x = table("embeddings")
    tree = neighbours.ProjectionTree(ids, x, float(np.sqrt((x**2).sum(1).max())) * (1 + 1e-9), 20)
    asked = np.flatnonzero(ids % 20 == 0)
    got = tree.search(ids[asked], x[asked], 20)
    hit = sum(len({i for i, _ in exact(ids, x, q, 20)} & set(got[1][got[0] == ids[q]].tolist())) for q in asked)
    assert hit / (20 * len(asked)) >= 0.9 and tree.verified < 0.5 * tree.possible


def test_rows_of_one_id_all_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (0, [0.25, 0.0])]
    got = impact.exact_top_k(frame(spark, rows), F.col("vec_id") == 0, 5, 4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 16), (1, 16), (1, 8), (1, 4), (1, 4)]
    got = neighbours.nearest_neighbours(frame(spark, rows[:5]), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (1, 1.0), (1, 0.5)]


def test_neighbours(spark):
    x = clustered(3, 1500, 32, 20) * np.linspace(0.5, 2, 1500, dtype=np.float32)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(40)]
    extra = [(6000, None), (6020, [0.0] * 32), (6040, [float("nan")] * 32), (None, x[1].tolist()), (6060, [])]
    got = {}
    for r in neighbours.nearest_neighbours(frame(spark, rows + extra), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, _ in rows])
    v = np.array([w for _, w in rows], np.float32).astype(float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        for _, i, s in own:
            assert abs(s - v[q] @ v[np.flatnonzero(ids == i)[0]]) < 1e-9
        want = {i for i, _ in exact(ids, v, q, 20)}
        hit += len(want & {i for _, i, _ in own})
        total += 20
    assert len(got) == int((ids % 20 == 0).sum()) and hit / total >= 0.9
    assert neighbours.nearest_neighbours(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest_neighbours(frame(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_chi_square():
    """The table's 95 % point of 28 degrees of freedom."""
    assert neighbours.DIM == 28 and abs(float(neighbours.chi_square_cdf(np.array([41.337]))[0]) - 0.95) < 1e-4
