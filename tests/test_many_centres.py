"""The nearest of many centres, as a table, against all distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import clustering


def brute(points, centres):
    out = []
    for p in points:
        d = ((centres - p) ** 2).sum(axis=1)
        out.append((int(d.argmin()), d.min()))
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_equal_to_all_distances(spark, monkeypatch, kind):
    monkeypatch.setattr(clustering, "BLOCK_COORDINATES", 300)
    monkeypatch.setattr(clustering, "POINTS_PER_GROUP", 40)
    monkeypatch.setattr(clustering, "PIVOTS", 16)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 10, (8, 3))
    centres = rng.normal(0, 1, (6000, 3)) if kind == "spread" else middle[rng.integers(0, 8, 6000)] + rng.normal(0, 0.1, (6000, 3))
    points = np.concatenate([rng.normal(0, 2, (200, 3)), middle + 0.01, np.repeat(centres[:1], 150, axis=0)])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, point array<double>").repartition(5)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster long, centre array<double>")
    got = {r.id: (r.cluster, r.distance) for r in clustering.kmeans_assign(frame, table, max_coordinates=1000).collect()}
    for i, (cluster, distance) in enumerate(brute(points, centres)):
        assert got[i][0] == cluster and got[i][1] == pytest.approx(distance, abs=1e-12)


def test_points_without_a_nearest_centre_stay(spark, monkeypatch):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [9.0, 9.0]), (6, []), (1, [0.0, 1.0])], "id int, point array<double>")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 8.0]), (2, [9.0, 8.0])], "cluster long, centre array<double>")
    rows = sorted(((r.id, r.cluster, r.distance) for r in clustering.nearest_of_many(points, centres).collect()), key=str)
    assert rows == sorted([(1, 0, 1.0), (1, 0, 1.0), (5, 1, 1.0), *((i, None, None) for i in (2, 3, 4, 6))], key=str)
    assert clustering.nearest_of_many(points.limit(0), centres).collect() == []


def test_centres_are_not_in_the_plan(spark):
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(rng.normal(0, 1, (100_000, 2)))], "cluster long, centre array<double>").repartition(4)
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(0, 1, (300, 2)))], "id int, point array<double>")
    found = clustering.kmeans_assign(points, table, max_coordinates=50_000)
    assert found.filter("distance > 0.01").count() < 30 and found.count() == 300


def test_lists_of_blocks_leave_for_a_few_points_at_a_time(monkeypatch):
    monkeypatch.setattr(clustering, "MAX_DISTANCES", 60)
    rng = np.random.default_rng(5)
    pivots, points = rng.normal(0, 1, (4, 3)), rng.normal(0, 1, (25, 3))
    blocks = np.array([[i % 4, 0.0, 0.5 + i] for i in range(12)])
    limits = rng.uniform(0, 2, 25)
    batch = pa.RecordBatch.from_pydict({
        "__row": np.arange(25), "__point": pa.array(points.tolist()), "__seen": np.zeros(25, np.int64), "__limit": limits})
    parts = list(clustering._bounds(pivots, blocks, True)(iter([batch])))
    assert [p.num_rows for p in parts] == [5] * 5
    found = {r["__row"]: r["blocks"] for p in parts for r in p.to_pylist()}
    away = np.sqrt(((points[:, None] - pivots) ** 2).sum(axis=2))[:, blocks[:, 0].astype(int)]
    least = np.maximum(np.maximum(away - blocks[:, 2], blocks[:, 1] - away), 0)
    assert found == {i: np.flatnonzero(least[i] <= np.sqrt(limits[i])).tolist() for i in range(25)}
