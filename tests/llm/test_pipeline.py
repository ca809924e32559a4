from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from millrace.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() == len(ids)
        before = ids
    again = sorted(map(tuple, pipeline.run(spark, SF_DIR).collect()))
    assert again == sorted(map(tuple, docs.collect()))


def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward.withColumn("n_chars", awkward["doc_id"]), nothing):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()


def test_all_queries_are_registered():
    assert {f"op{i}" for i in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(oracles.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = queries.QUERIES[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
