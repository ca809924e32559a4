from __future__ import annotations

import random
import zlib

import pytest

from millrace.llm import toxicity
from tests.llm.conftest import prose

INSULTS = ["wretch", "fiend", "zounds"]


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = i % 6 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), i))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_are_told_apart(corpus):
    docs, labels = corpus
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 600
    assert all(r["held_out"] == (remainder(r["doc_id"]) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.97


def test_held_out_labels_are_never_read(corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, toxicity.score(docs, labels).collect())) == sorted(map(tuple, toxicity.score(docs, flipped).collect()))


def test_awkward_rows_and_missing_labels(spark, awkward, awkward_rows, nothing, corpus):
    _, labels = corpus
    some = labels.filter("doc_id < 40").union(spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int"))
    rows = toxicity.score(awkward, some).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in awkward_rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    for known in (labels.filter("toxic = 0"), labels.filter("false")):
        assert len({r["score"] for r in toxicity.score(awkward, known).collect()}) == 1
    assert toxicity.score(nothing, labels).collect() == []
