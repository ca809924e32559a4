from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import filters


def brute(rows, labels):
    """Rows of the audit of (doc_id, text, lang) and (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and t == 1 for j, _, t in labels if j is not None)
        failed.append((lang or "", fails, good, toxic))
    out = []
    for part in {p for p, *_ in failed}:
        mine = [r[1:] for r in failed if r[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for i, x in enumerate(order):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                earlier = sum(r[0][x] and any(r[0][y] for y in order[:i]) for r in mine)
                alone = sum(r[0][x] and sum(r[0].values()) == 1 for r in mine)
                shapley[x] += len(gone)
                steps.append((order, i + 1, len(left), len(gone), earlier, alone, sum(g for _, g, _ in gone), sum(t for _, _, t in gone)))
        out += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def table(awkward_rows):
    rng = random.Random(3)
    langs = ["en", "de", None, ""]
    rows = [(i, text, rng.choice(langs)) for i, text in awkward_rows]
    some = " ".join(f"w{i}" for i in range(220))
    rows += [(500 + i, some, "en") for i in range(300)] + [(490, some, "de"), (None, some, "en"), (490, some, None)]
    rows += [(600, some + " #", "en"), (601, some.upper(), "en"), (602, "Ab " * 250, None), (603, some + " ", "en"), (604, "\x1c".join(["w"] * 250), "x")]
    return rows


@pytest.fixture(scope="module")
def labels(table):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in table[::2]]
    return [*rows, (None, 1, 1), (500, 1, 0), (500, 0, 1), (99_999, 1, 1)]


@pytest.mark.parametrize("bits", [None, 10])
def test_audit_equals_brute_force(spark, table, labels, bits):
    docs = spark.createDataFrame([(*r, "x", {"a": 1}) for r in table], "doc_id long, text string, lang string, mask string, hash map<string, int>")
    said = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filters.audit(docs.repartition(5), said, bits)
    assert sorted(map(tuple, got.collect())) == brute(table, labels)


def test_empty_tables(spark, table):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs, said).collect() == []
    some = spark.createDataFrame(table, "doc_id long, text string, lang string")
    assert sorted(map(tuple, filters.audit(some, said).collect())) == brute(table, [])


def test_sketch_clears_unique_hashes_and_no_repeat(spark):
    rng = np.random.default_rng(5)
    unique, twice = rng.integers(-2**63, 2**63, 30_000), rng.integers(-2**63, 2**63, 500)
    frame = spark.createDataFrame([(int(x),) for x in [*unique, *twice, *twice, *[7] * 20_000]], "hash long").repartition(7)
    may = filters.repeat_test(frame, filters.sketch_bits(51_000))
    kept = {r[0] for r in frame.filter(may(F.col("hash"))).collect()}
    assert {*twice.tolist(), 7} <= kept
    assert len(kept - {*twice.tolist(), 7}) < 0.1 * len(unique)
