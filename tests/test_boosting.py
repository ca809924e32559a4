"""Trees against a plain learner that sorts all rows in one place."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting


def grown(x, residual, depth, borders, category, names):
    """value of every row by the best splits of all rows, found one by one."""
    def leaf(rows, left):
        value = np.full(len(x), np.nan)
        value[rows] = residual[rows].mean()
        if not left:
            return value
        best = None
        tests = [x[:, i] <= t for i in range(x.shape[1]) for t in borders[i]] + [category == c for c in names[:-1]]
        for test in tests:
            a, b = rows[test[rows]], rows[~test[rows]]
            if len(a) and len(b):
                gain = residual[a].sum() ** 2 / len(a) + residual[b].sum() ** 2 / len(b) - residual[rows].sum() ** 2 / len(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, a, b)
        if best is None:
            return value
        for part in best[1:]:
            below = leaf(part, left - 1)
            value[part] = below[part]
        return value

    return leaf(np.arange(len(x)), depth)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(500):
        x, kind = rng.gauss(0, 1), rng.choice(["p", "q", "q", "r"])
        out.append((i, x if i % 9 else None, float(rng.randrange(6)), kind, int(x + (kind == "q") + rng.gauss(0, 0.3) > 0.6)))
    return out


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_equal_a_plain_learner(spark, rows, depth):
    df = spark.createDataFrame(rows, "i long, x double, z double, kind string, label int").repartition(4)
    models, _ = boosting.grow(df, [boosting.Point(depth, 8)], F.lit(0), 1, F.col("i"), "label", ["x", "z"], "kind", iterations=3, subsample=1.0)
    got = {r.i: r.margin for r in models[0].score(df).collect()}
    known = [r[1] for r in rows if r[1] is not None]
    x = np.array([[np.mean(known) if r[1] is None else r[1], r[2]] for r in rows])
    y = np.array([2.0 * r[4] - 1 for r in rows])
    kind = np.array([r[3] for r in rows])
    names = sorted(set(kind), key=lambda k: (-(kind == k).sum(), k))
    margin = np.zeros(len(rows))
    for i in range(3):
        residual = y if i == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        margin += (1.0 if i == 0 else 0.1) * grown(x, residual, depth, models[0].preparation.borders[8], kind, names)
    assert [got[r[0]] for r in rows] == pytest.approx(margin.tolist())


def test_folds_are_left_out_and_models_saved(spark, rows):
    df = spark.createDataFrame(rows, "i long, x double, z double, kind string, label int")
    fold = F.pmod("i", F.lit(2))
    points = [boosting.Point(2, 6, 0), boosting.Point(2, 6, 1), boosting.Point(2, 12, 1), boosting.Point(2, 6)]
    models, binned = boosting.grow(df, points, fold, 2, F.col("i"), "label", ["x", "z"], "kind", iterations=7, subsample=0.7)
    alone, _ = boosting.grow(df.filter(fold == 1), [boosting.Point(2, 6)], F.lit(0), 1, F.col("i"), "label", ["x", "z"], "kind", iterations=7, subsample=0.7)
    assert models[0].preparation.means == pytest.approx(alone[0].preparation.means)
    for a, b in zip(models[0].trees, alone[0].trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.value == pytest.approx(b.value)
    held = boosting.held_out(binned, models[:3])
    assert {(r.model, r.fold): r["count"] for r in held.groupBy("model", "fold").count().collect()} == {(0, 0): 250, (1, 1): 250, (2, 1): 250}
    again = boosting.Model.read(models[3].text())
    assert [r.margin for r in again.score(df).collect()] == pytest.approx([r.margin for r in models[3].score(df).collect()])


def test_empty_and_one_sided_rows(spark):
    schema = "i long, x double, kind string, label int"
    for rows in ([], [(1, 2.0, "a", 1), (2, None, None, 1)], [(1, None, "a", None)]):
        df = spark.createDataFrame(rows, schema)
        models, _ = boosting.grow(df, [boosting.Point(3, 4)], F.lit(0), 1, F.col("i"), "label", ["x"], "kind", iterations=2)
        assert all(r.margin >= 0 for r in models[0].score(df).collect())


def test_sums_of_many_nodes_leave_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    layout, point, n = boosting.Layout(0, [8], 2, 3), boosting.Point(4, 8), 300
    tree = boosting.Tree.of(4)
    for node in range(7):
        tree.feature[node], tree.cut[node], tree.feature[2 * node + 1:2 * node + 3] = node % 2, 3, boosting.OPEN
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.zeros(n, np.int32)), pa.array(rng.choice([-1.0, 1.0], n)), pa.array(np.arange(n)),
        pa.array([x.tobytes() for x in rng.integers(0, 8, (n, 2)).astype(np.uint8)], pa.binary()),
        pa.array(rng.integers(0, 3, n).astype(np.int32)), pa.array([b""] * n, pa.binary())],
        ["fold", "label", "key", "bins", "category", "margins"])
    state = boosting.Growing(layout, [point], [[tree]], 0, 0.1, 1.0, 7)
    whole = pa.Table.from_batches(state.sums(iter([batch])))
    monkeypatch.setattr(boosting, "SUMS_PER_BATCH", 2 * layout.width(point))
    parts = list(state.sums(iter([batch])))
    assert max(p.num_rows for p in parts) <= 2 < whole.num_rows
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
