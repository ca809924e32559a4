"""Every registered query on the smallest tables: its equivalent in DuckDB, and the shape of its plan."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(table):
    names = sorted(table.column_names)
    rows = zip(*(table.column(n).to_pylist() for n in names))
    return names, sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    # A window in one task is fine only over `__rows`, one row per partition.
    assert not re.search(r"Window (?!\[sum\(__rows)[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", plan)
    got = df.toArrow()
    if name not in entry.oracle_sql():
        assert got.num_rows > 0
        return
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    (names, rows), (want_names, want_rows) = in_order(got), in_order(want)
    assert names == want_names and len(rows) == len(want_rows)
    assert [str(got.schema.field(n).type).replace("large_", "") for n in names] == [
        str(want.schema.field(n).type) for n in names]
    for row, want_row in zip(rows, want_rows):
        assert all(map(close, row, want_row)), (row, want_row)


def test_every_equivalent_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["order_id", "order_date", "sum_goods_price"]
