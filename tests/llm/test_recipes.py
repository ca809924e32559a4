from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from millrace.llm import recipes
from millrace.llm.words import Texts
from tests.llm.conftest import prose


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[clean(text)].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(awkward_rows):
    import random

    rng = random.Random(9)
    long = prose(rng, 20_000)
    hot = prose(rng, 50)
    return [*awkward_rows, (700, long), (699, long.replace(" ", "\n \t", 40)), (701, long[:-1]), (702, "x" + long), (None, long), (703, "y " * 60_000),
            (704, "y " * 60_000), (705, "y " * 60_000 + "z"), *((800 + i, f" {hot}" if i % 2 else f"\n{hot}") for i in range(200))]


def test_report_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, {"a": 1}, "x") for r in rows], "doc_id long, text string, row map<string, int>, recipe string").repartition(5)
    assert sorted(map(tuple, recipes.report(docs).collect()), key=str) == brute(rows)


def test_colliding_digests_are_made_longer(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert recipes.verified(docs, 1) > 1
    assert sorted(map(tuple, recipes.report(docs, 1).collect()), key=str) == brute(rows)


def test_one_row_of_each_text_stays(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __recipe_row string")
    kept = recipes.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, stays, _ in brute(rows) if stays), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_empty_table(spark, nothing):
    assert recipes.report(nothing).collect() == [] and recipes.keep_one(nothing).collect() == []


def test_chunks_depend_on_the_text_alone(rows):
    texts = [clean(t).encode() for _, t in rows]
    data, bounds = recipes.normalised(Texts(pa.array([t for _, t in rows])))
    assert [data.tobytes()[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == texts
    for text, low, ends in zip(texts, bounds[:-1].tolist(), recipes.chunk_ends(data, bounds), strict=True):
        alone, cuts = recipes.normalised(Texts(pa.array([text.decode()])))
        assert recipes.chunk_ends(alone, cuts)[0] == [e - low for e in ends]
        sizes = [b - a for a, b in itertools.pairwise([low, *ends])]
        assert sum(sizes) == len(text) and all(recipes.MIN <= s <= recipes.MAX for s in sizes[:-1])
    # A byte before a long text moves the cuts, and does not change most chunks.
    longest = max(texts[:-210], key=len)
    cut = [set(), set()]
    for side, text in zip(cut, (longest, b"x" + longest), strict=True):
        data, bounds = recipes.normalised(Texts(pa.array([text.decode()])))
        ends = recipes.chunk_ends(data, bounds)[0]
        side.update(data.tobytes()[a:b] for a, b in itertools.pairwise([0, *ends]))
    assert len(cut[0] & cut[1]) >= 0.5 * len(cut[0])
