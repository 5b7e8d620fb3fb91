import numpy as np
import pytest
from pyspark.sql import functions as F

from civicsift.llm import multi_index


def brute(rows, top=20):
    out = {}
    for query, wanted in rows:
        if query % 20 == 0:
            scored = [(-float(np.dot(wanted, v)), number) for number, v in rows if number != query]
            out[query] = [number for _, number in sorted(scored)[:top]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.6
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[500:1500] = points[500]  # a third of all vectors is one
    return [(n, v.astype(np.float32).astype(float)) for n, v in enumerate(points)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(n, [float(x) for x in v], 1, "clash") for n, v in rows], "vec_id long, embedding array<float>, rank int, cell string")
    out = {}
    for r in multi_index.nearest(frame, F.col("id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_ranks_and_scores(spark, vectors, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_FOUND", 300)
    monkeypatch.setattr(multi_index, "TASK_VECTORS", 100)
    monkeypatch.setattr(multi_index, "TASK_QUERIES", 40)
    got, want, by_id = found(spark, vectors), brute(vectors), dict(vectors)
    assert got.keys() == want.keys()
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    for query, ranked in got.items():
        assert [rank for rank, _, _ in ranked] == list(range(1, 21))
        assert [(-s, v) for _, v, s in ranked] == sorted((-s, v) for _, v, s in ranked)
        assert all(s == pytest.approx(np.dot(by_id[query], by_id[v]), abs=1e-12) for _, v, s in ranked)


def test_small_tables_are_searched_whole(spark, vectors):
    rows = vectors[:30]
    assert {q: [v for _, v, _ in ranked] for q, ranked in found(spark, rows, top=40).items()} == brute(rows, 40)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0]), (7, []), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (9, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in multi_index.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 0.5), (0, 2, 9, 0.5), (0, 3, 20, 0.0), (20, 1, 8, 0.5), (20, 2, 9, 0.5), (20, 3, 0, 0.0)]
    assert multi_index.nearest(frame.limit(0), F.col("id") % 20 == 0).collect() == []


def test_one_longer_vector_changes_nothing(spark, vectors):
    rows = vectors[:60]
    assert found(spark, [*rows, (5000, [0.5] * 17)]) == found(spark, rows)


def test_walk_goes_down_the_sums(vectors):
    rng = np.random.default_rng(2)
    first, second = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    counts = rng.integers(0, 4, (7, 5))
    index, query = multi_index.MultiIndex(first, second, counts), rng.normal(size=6)
    sums = first @ query[:3][:, None] + (second @ query[3:])[None, :]
    want = [divmod(int(at), 5) for at in np.argsort(-sums, axis=None, kind="stable")]
    assert index.walk(query) == [cell for cell in want if counts[cell]]
