from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np

from millrace.llm import neardup
from millrace.llm.components import Scratch, components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(a, b):
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def brute_classes(rows):
    known = sorted({(i is not None, i, t) for i, t in rows if t is not None}, key=lambda r: (r[2], r[0], r[1] or 0))
    texts = {}
    for _, i, t in known:
        texts.setdefault(t, []).append(i)
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {t: bag(t) for t in texts}
    for a, b in itertools.combinations(texts, 2):
        x, y = bags[a], bags[b]
        if x.keys() & y.keys() and len(x.keys() & y.keys()) > 0.4 * min(len(x), len(y)) and brute(x, y) >= 0.8:
            parent[find(a)] = find(b)
    smallest = {}
    for t, ids in texts.items():
        ids = [i for i in ids if i is not None]
        smallest.setdefault(find(t), []).extend(ids)
    return {t: min(smallest[find(t)], default=None) for t in texts}


def test_similarity_is_the_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sides = []
        for _ in range(2):
            keys = np.sort(rng.choice(20, rng.integers(1, 15), replace=False)).astype(np.uint64)
            sides.append((keys, rng.integers(1, 5, len(keys)).astype(float)))
        a, b = (Counter(dict(zip(k.tolist(), w.tolist(), strict=True))) for k, w in sides)
        assert abs(neardup.similarity(*sides) - brute(a, b)) < 1e-9


def test_registers_agree_as_often_as_the_similarity_says():
    a = Counter({i: 1.0 + i % 3 for i in range(60)})
    b = Counter({i: (1.0 + i % 3) * (2 if i < 10 else 1) for i in range(8, 70)})
    text = np.repeat([0, 1], [len(a), len(b)])
    runs = neardup.mix(np.array([*a, *b], dtype=np.uint64))
    rows = neardup.sketch(text, runs, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((rows[0] == rows[1]).mean() - brute(a, b)) < 0.04


def test_classes_equal_brute_force(awkward, awkward_rows):
    want = brute_classes(awkward_rows)
    got = neardup.classes(awkward).collect()
    assert len(got) == len(awkward_rows)
    texts = {}
    for i, t in awkward_rows:
        texts.setdefault(i, set()).add(t)
    for row in got:
        if row["doc_id"] is not None and texts[row["doc_id"]] != {None}:
            (text,) = texts[row["doc_id"]]
            assert row["class_id"] == want[text], row
    assert [r["class_id"] for r in got if r["doc_id"] == 400] == [400]


def test_one_row_of_each_class_stays(awkward, awkward_rows):
    want = brute_classes(awkward_rows)
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    with_text = [r for r in rows if r[1] is not None]
    assert len(with_text) == len(set(want.values()) | {t for t in want if want[t] is None})
    assert all(i == want[t] for i, t in with_text)
    assert sum(t is None for _, t in rows) == sum(t is None for _, t in awkward_rows)


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch, awkward, awkward_rows):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    want = brute_classes(awkward_rows)
    got = neardup.classes(awkward).filter("doc_id BETWEEN 200 AND 299").select("class_id").distinct().collect()
    assert [r[0] for r in got] == sorted({want[t] for i, t in awkward_rows if i and 200 <= i < 300})


def test_empty_table(nothing):
    assert neardup.classes(nothing).collect() == []
    assert neardup.keep_one(nothing).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    names = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "test")).collect()}
    assert names == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
