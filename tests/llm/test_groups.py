from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm import groups, lexicon, maxent, passages
from tests.llm.test_maxent import brute as tokens
from tests.llm.test_passages import brute as passage_words


@pytest.mark.parametrize("doc", [None, 7])
def test_no_group_holds_all_rows_of_an_id(spark, doc):
    docs = spark.createDataFrame([(doc, f"text {i} " * 20) for i in range(400)] + [(i, "other " * 20) for i in range(100)], "doc_id long, text string")
    sizes = groups.dealt(docs, 4000, "part", "copies").groupBy("part").agg(F.sum("copies").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 500 and max(r["n"] for r in sizes) < 100


def test_equal_rows_are_taken_once_and_given_back(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "GROUP_BYTES", 2000)
    monkeypatch.setattr(passages, "GROUP_BYTES", 2000)
    same = " ".join(f"word{i}" for i in range(30))
    rows = [(None, same)] * 60 + [(7, same)] * 60 + [(3, f"{same} end")] + [(None, None)] * 90 + [(i, f"own text {i}") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = groups.dealt(docs, 2000, "part", "copies").collect()
    assert sum(r["copies"] for r in dealt) == len(rows) and len(dealt) == 24
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.repeated_words(docs).collect()), key=str)
    assert got == sorted(((i, len(w), sum(c)) for (i, _), (w, c) in zip(rows, passage_words(rows, 13), strict=True)), key=str)
    scored = sorted((tuple(r)[:5] for r in maxent.score(docs).collect()), key=str)
    assert scored == sorted((r[:5] for r in tokens(rows)), key=str)
