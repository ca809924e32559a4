from __future__ import annotations

import zlib

import pytest

from millrace.llm import sharding


def held(rows, shards):
    total, largest = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    sums = {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert all(abs(sums.get(i, 0) - total / shards) <= largest for i in range(shards))
    for i in sums:
        assert sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(sum(r["shard"] == i for r in rows)))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_all_rows_in_shards_of_near_equal_bytes(awkward, awkward_rows, shards):
    rows = sharding.report(awkward, shards).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in awkward_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    held(rows, shards)


def test_copies_of_one_text_are_split(spark):
    docs = spark.range(3000).selectExpr("id - 1500 AS doc_id", "'the same' AS text")
    rows = sharding.place(docs, 40).collect()
    assert {sum(r["shard"] == i for r in rows) for i in range(40)} == {75}


def test_equal_rows_are_split(spark):
    rows = [(None, None)] * 700 + [(7, "the same row " * 20)] * 100 + [(i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.place(docs, 40).collect()
    held(found, 40)
    assert len({r["shard"] for r in found}) == 40


def test_a_tolerance_needs_fewer_probes(awkward):
    rows = sharding.place(awkward, 5, tolerance=500.0).collect()
    held(rows, 5)


def test_written_shards(spark, awkward, folder):
    sharding.write_shards(awkward, f"{folder}/shards", 4)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == awkward.count() and set(awkward.columns) <= set(back.columns)


def test_empty_table(nothing):
    assert sharding.report(nothing).collect() == []
