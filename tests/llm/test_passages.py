from __future__ import annotations

import hashlib
import re

import pytest

from millrace.llm import passages


def brute(rows, length):
    """For each row: its words, and which of them a repeated passage covers."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first = {}
    for (doc, _), row in zip(rows, words, strict=True):
        for i in range(len(row) - length + 1):
            key = tuple(row[i:i + length])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    covered = []
    for (doc, _), row in zip(rows, words, strict=True):
        inside = [False] * len(row)
        for i in range(len(row) - length + 1):
            if doc is not None and first[tuple(row[i:i + length])] < doc:
                inside[i:i + length] = [True] * length
        covered.append(inside)
    return list(zip(words, covered, strict=True))


@pytest.mark.parametrize(("length", "start"), [(13, 7), (13, 13), (40, 10), (9, 2)])
def test_repeated_words_equal_brute_force(awkward, awkward_rows, length, start):
    got = [tuple(r) for r in passages.repeated_words(awkward, length, start).collect()]
    want = []
    for (doc, _), (words, covered) in zip(awkward_rows, brute(awkward_rows, length), strict=True):
        kept = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        want.append((doc, len(words), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_levels_double_up_to_the_length():
    assert passages.levels(13, 7) == [7, 13]
    assert passages.levels(100, 13) == [13, 26, 52, 100]
    assert passages.levels(5, 7) == [5]


def test_cuts_leave_other_text_as_it_is(awkward, awkward_rows):
    cut = passages.cut_repeats(awkward, 40, 10)
    assert cut.schema == awkward.schema
    got = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str)
    assert len(got) == len(awkward_rows)
    want = []
    for (doc, text), (words, covered) in zip(awkward_rows, brute(awkward_rows, 40), strict=True):
        want.append((doc, [w for w, c in zip(words, covered, strict=True) if not c], text if not any(covered) else None))
    texts = {}
    for doc, text in got:
        texts.setdefault(doc, []).append(text)
    for doc, words, whole in want:
        if doc is None:
            continue
        assert all(re.findall(r"[^\x20\x09-\x0D]+", t or "") == words for t in texts[doc])
        assert whole is None or whole in texts[doc]


def test_empty_table(nothing):
    assert passages.repeated_words(nothing).collect() == []
    assert passages.cut_repeats(nothing).collect() == []


def test_any_columns_may_come_along(spark):
    same = " ".join(f"word{i}" for i in range(30))
    rows = [(i, same if i % 2 else f"own text {i}", {"a": i, "b": None}, [i], (i, {"x": 1.5}), "p", "c", 7) for i in range(12)] * 2
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, m map<string, int>, a array<int>, s struct<i: int, m: map<string, double>>, __part string, __copies string, __row int")
    cut = passages.cut_repeats(docs, 13, 7)
    assert cut.schema == docs.schema
    got = sorted(map(str, cut.collect()))
    want = [(i, "" if i % 2 and i > 1 else text, *rest) for i, text, *rest in rows]
    assert got == sorted(map(str, spark.createDataFrame(want, docs.schema).collect()))


def test_hot_rows_with_maps_are_taken_once(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP_BYTES", 500)
    rows = [(1, "some words that come again", {"a": 1, "b": 2})] * 200 + [(2, "others", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    assert sorted(map(str, passages.cut_repeats(docs, 3, 2).collect())) == sorted(map(str, docs.collect()))
