from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from millrace.llm import quality
from tests.llm.conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, duplicate = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            duplicate += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts, inside = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicate, len(inside), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i != 2 else None, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def test_base_columns_equal_brute_force(awkward, awkward_rows, labels):
    got = quality.judge(awkward, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t in awkward_rows), key=str)


def test_junk_is_told_from_prose(spark):
    junk = spark.createDataFrame([(1000 + i, " | ".join(f"{chr(65 + (i * j) % 26) * 3}%%% $$${j}" for j in range(40))) for i in range(10)], "doc_id long, text string")
    rng = random.Random(4)
    good = spark.createDataFrame([(i, prose(rng, 500)) for i in range(200)], "doc_id long, text string")
    rows = quality.judge(good.union(junk), spark.range(100).selectExpr("id AS doc_id", "1 AS quality")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == set(range(200))


def test_kept_rows_have_all_columns(awkward, labels):
    kept = quality.keep_good(awkward, labels)
    judged = quality.judge(awkward, labels).filter("kept").select("doc_id").collect()
    assert kept.schema == awkward.schema
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in judged)


def test_without_labels_or_rows(awkward, nothing, labels):
    none = labels.filter("false")
    assert {r["score"] for r in quality.judge(awkward, none).collect()} == {0.0}
    assert quality.judge(nothing, labels).collect() == []
    assert quality.judge(nothing, none).collect() == []
