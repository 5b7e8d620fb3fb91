import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicsift.llm import cover_tree

CLASHING = "row long, id string, task int, lane int, vector string, `a.b` string"
SCHEMA = f"vec_id long, embedding array<float>, label int, {CLASHING}"


def whole(vector, length):
    top = cover_tree.SATURATED
    out = [math.floor(min(max(256.0 * float(np.float32(x)), -top), top)) for x in vector]
    return out + [0] * (length - len(out))


def brute_force(rows, every=50, n_positives=5, n_negatives=3):
    kept = [(i, v, label) for i, v, label in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, whole(v, length), (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in kept]
    out = []

    def order(pair):
        return -pair[0], pair[1] is None, pair[1] or 0

    for at, (anchor, query, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(query, v, strict=True)), i, other)
                  for k, (i, v, other) in enumerate(kept) if k != at]
        best = sorted(((s, i) for s, i, other in scored if other == label), key=order)[:n_positives]
        for positive_score, positive in best:
            inside = sorted(((s, i) for s, i, other in scored
                             if other != label and 50 * positive_score <= 100 * s <= 95 * positive_score), key=order)
            out += [(anchor, positive, rank, negative, positive_score, score)
                    for rank, (score, negative) in enumerate(inside[:n_negatives], 1)]
    return sorted(out, key=repr)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in cover_tree.mine(df, F.col("id") % 50 == 0, label).collect()), key=repr)


def frame_of(spark, rows):
    extra = (1, "i", 2, 3, "v", "a")
    return spark.createDataFrame([(*row, *extra) for row in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for number in range(900):
        at = number % 12
        vector = centres[at] * rng.choice([0.5, 1.0, 1.5]) + rng.normal(size=16) * 0.15
        rows.append((number, [float(np.float32(x)) for x in vector], at % 4))
    return rows


def test_clusters_equal_brute_force(spark, clustered):
    expected = brute_force(clustered)
    assert len(expected) > 50
    assert mined(frame_of(spark, clustered)) == expected


def test_messy_rows_equal_brute_force(spark, clustered):
    rows = clustered[:120] + [clustered[50]] * 3 + [(None, clustered[3][1], 0), (None, clustered[4][1], None)]
    rows += [(1000 + k, clustered[50][1], 3) for k in range(40)]  # ties
    rows += [(1050, None, 1), (1051, [], 1), (1100, [1.0], 1), (1101, [float("nan")] * 16, 1), (1102, [None] * 16, 2),
             (1103, [float("inf")] + [0.0] * 15, 2), (1150, [0.0] * 16, 2), (1151, [3e38] * 16, 2), (1152, [-3e38] * 16, 2),
             (-50, clustered[7][1], 3), (1200, [0.25] * 20, 1)]
    assert mined(frame_of(spark, rows)) == brute_force(rows)


def test_empty_tables(spark):
    assert mined(frame_of(spark, [])) == []
    assert mined(frame_of(spark, [(50, None, 1), (100, [1.0], None)])) == []
    assert mined(frame_of(spark, [(50, [], 1), (100, [], 1), (1, [], 2)])) == brute_force(
        [(50, [], 1), (100, [], 1), (1, [], 2)])


def test_small_tasks_and_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(cover_tree, "TASK_ROWS", 40)
    monkeypatch.setattr(cover_tree, "TASK_ANCHORS", 5)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    monkeypatch.setattr(cover_tree, "LEAST_FILL", 2)
    assert mined(frame_of(spark, clustered)) == brute_force(clustered)


def test_a_tree_covers_separates_and_prunes(clustered):
    points = np.array([whole(v, 16) for _, v, _ in clustered], np.float64)
    tree = cover_tree.CoverTree(points)
    assert max(len(node.children) for node in tree.nodes) > 1 and len(tree.nodes) > 20
    for node in tree.nodes:
        apart = np.linalg.norm(tree.augmented[node.rows] - tree.augmented[node.centre], axis=1)
        assert np.isclose(apart.max(), node.radius)
        if node.children:
            below = np.concatenate([tree.nodes[child].rows for child in node.children])
            assert sorted(below) == sorted(node.rows) and tree.nodes[node.children[0]].centre == node.centre
            centres = tree.augmented[[tree.nodes[child].centre for child in node.children]]
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(centres), 1)]
            assert (gaps > node.radius / cover_tree.SHRINK - 1e-6).all()
    scored = 0

    class Counting(cover_tree.Wanted):
        def offer(self, rows, scores):
            nonlocal scored
            scored += len(rows)
            super().offer(rows, scores)

    for query in points[:50]:
        low, high = tree.bounds(query)
        exact = points @ query
        assert all((exact[node.rows] >= low[k]).all() and (exact[node.rows] <= high[k]).all()
                   for k, node in enumerate(tree.nodes))
        want = Counting(5, np.ones(len(points), bool), np.arange(len(points)))
        tree.descend(query, [want], True)
        assert want.scores.tolist() == sorted(exact, reverse=True)[:5]
    assert scored < 0.5 * 50 * len(points)
