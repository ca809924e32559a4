from __future__ import annotations

import datetime
import math
import random
import re
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.ordering import exact_quantile, exact_quantiles, number_rows
from millrace.session import store


def skewed_rows(n=3000, seed=1):
    """(group, value, id): a third of the rows in one group, some without a group, many equal values."""
    rng = random.Random(seed)
    groups = ["hot"] * (n // 3) + [None] * 50 + [f"g{rng.randrange(40)}" for _ in range(n - n // 3 - 50)]
    return [(g, float(rng.choice([7, rng.randrange(500)])), i) for i, g in enumerate(rng.sample(groups, n))]


def by_group(rows):
    groups = defaultdict(list)
    for g, value, i in rows:
        groups[g].append((value, i))
    return {g: sorted(v) for g, v in groups.items()}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed_rows(), "g string, value double, id long").repartition(7).persist()


def test_numbers_per_group(frame):
    got = {r.id: r.n for r in number_rows(frame, ["value", "id"], by=["g"], name="n").collect()}
    want = {i: n for v in by_group(skewed_rows()).values() for n, (_, i) in enumerate(v)}
    assert got == want


def test_numbers_over_the_whole_table(frame):
    got = [r.row_id for r in number_rows(frame, [F.desc("value"), "id"]).orderBy(F.desc("value"), "id").collect()]
    assert got == list(range(3000))


def test_numbers_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "a int"), ["a"]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantile_by_index(frame, q):
    got = {r.g: r.quantile for r in exact_quantile(frame, "value", q, by=["g"]).collect()}
    want = {g: v[min(math.floor(q * len(v)), len(v) - 1)][0] for g, v in by_group(skewed_rows()).items()}
    assert got == want


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_quantile_interpolated(frame, q):
    got = {r.g: r.quantile for r in exact_quantile(frame, "value", q, by=["g"], method="linear").collect()}
    for g, v in by_group(skewed_rows()).items():
        assert got[g] == pytest.approx(np.quantile([x for x, _ in v], q))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_lower_quantiles_of_several_columns(spark, frame, q):
    wide = frame.withColumn("other", F.when(F.col("id") % 2 == 0, -F.col("value")).otherwise(float("nan")))
    rows = exact_quantiles(wide, ["value", "other"], {"a": q, "b": 0.5}, by=["g"]).collect()
    exact = {r.g: r for r in wide.groupBy("g").agg(
        F.percentile_approx("value", q, 10**6).alias("value"),
        F.percentile_approx(F.when(~F.isnan("other"), F.col("other")), q, 10**6).alias("other")).collect()}
    assert len(rows) == len(exact)
    for r in rows:
        assert (r.value.a, r.other.a) == (exact[r.g].value, exact[r.g].other)


def test_quantile_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None)], "g int, v double")
    assert exact_quantile(df.filter("g = 1"), "v", 0.5, method="linear").head()[0] == 2.0
    got = {r.g: r.quantile for r in exact_quantile(df, "v", 0.5, by=["g"]).collect()}
    assert got == {1: 3.0, 2: None}
    assert exact_quantile(df.filter("v is null"), "v", 0.5).head().quantile is None


@pytest.mark.parametrize("targets, kept", [(20_000, 100_000), (20_000, 5), (8, 5), (2, 100_000)])
@pytest.mark.parametrize("method", ["index", "lower", "linear"])
def test_quantiles_by_counting(frame, monkeypatch, targets, kept, method):
    monkeypatch.setattr(ordering, "MAX_TARGETS", targets)
    monkeypatch.setattr(ordering, "KEPT", kept)
    monkeypatch.setattr(ordering, "CELLS", 64)
    if targets > 100:
        monkeypatch.setattr(ordering, "_ranked_rows", None)
    got = {r.g: r.quantile for r in exact_quantile(frame, "value", 0.3, by=["g"], method=method).collect()}
    for g, v in by_group(skewed_rows()).items():
        values = [x for x, _ in v]
        want = {"index": values[math.floor(0.3 * len(v))], "lower": values[math.ceil(0.3 * len(v)) - 1], "linear": np.quantile(values, 0.3)}
        assert got[g] == pytest.approx(want[method])
    assert len(got) == len(by_group(skewed_rows()))


@pytest.mark.parametrize("kind, make", [
    ("double", lambda r, i: r.choice([float("inf"), -float("inf"), 1e308, -1e308, 1e-300 * i, 1 + i * 1e-15, r.gauss(0, 1)])),
    ("bigint", lambda r, i: 2**62 + r.randrange(3000)), ("decimal(38,2)", lambda r, i: Decimal(10**30 + r.randrange(500)) / 100),
    ("date", lambda r, i: datetime.date(1960, 1, 1) + datetime.timedelta(r.randrange(40_000))), ("string", lambda r, i: f"s{r.randrange(900)}"),
    ("timestamp", lambda r, i: datetime.datetime(2020, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**9)))])
def test_quantiles_of_every_kind_of_value(spark, monkeypatch, kind, make):
    monkeypatch.setattr(ordering, "KEPT", 20)
    monkeypatch.setattr(ordering, "CELLS", 32)
    rng = random.Random(3)
    rows = [(i % 2, make(rng, i)) for i in range(1500)] + [(0, None), (5, None)]
    df = spark.createDataFrame(rows, f"g int, v {kind}").repartition(5)
    got = {r.g: r.quantile for r in exact_quantile(df, "v", 0.4, by=["g"]).collect()}
    for g in (0, 1):
        assert got[g] == sorted(v for h, v in rows if h == g and v is not None)[300]
    assert got[5] is None
    assert exact_quantile(df, "v", 0.9).head().quantile == sorted(v for _, v in rows if v is not None)[1350]


def test_no_exchange_of_all_values(spark, frame, monkeypatch):
    monkeypatch.setattr(ordering, "KEPT", 100)
    found = exact_quantile(store(frame), "value", 0.5, by=["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    # What is shuffled comes out of a partial aggregation, of rows that a broadcast table of bounds lets through.
    below = re.findall(r"Exchange (?!Single)[^\n]*\n[^\n]*?([A-Z]\w+)", plan)
    assert below and set(below) <= {"HashAggregate", "Project", "BroadcastExchange"} and "SortMergeJoin" not in plan


def test_sketches_are_near_in_rank(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 9}", v) for i, v in enumerate(values)] + [("none", None), ("nan", float("nan"))], "g string, v double")
    got = {r.g: r.v for r in ordering.approx_quantiles(df.repartition(40), ["v"], {"a": 0.1, "b": 0.5}, ["g"], k=1000).collect()}
    hot = sorted(v for i, v in enumerate(values) if i % 3)
    for q, name in ((0.1, "a"), (0.5, "b")):
        assert abs(sum(v <= got["hot"][name] for v in hot) / len(hot) - q) < 0.01
    assert got["none"].a is None and got["nan"].b is None
    assert ordering.sketch_size(10**6) == 65_535 and ordering.sketch_size(100) < 600
    whole = ordering.approx_quantiles(df, ["v"], {"b": 0.5}).head().v.b
    assert abs(sum(v <= whole for v in values) / len(values) - 0.5) < 0.01


def test_running_totals(spark, frame):
    counted = frame.groupBy("g", "value").count()
    got = {(r.g, r.value): r.before for r in ordering.running_totals(counted.repartition(9), {"count": "before"}, [F.desc("value")], ["g"]).collect()}
    for g, v in by_group(skewed_rows()).items():
        for value in {x for x, _ in v}:
            assert got[g, value] == sum(x > value for x, _ in v)
