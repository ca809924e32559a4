from __future__ import annotations

import hashlib
import random
import re

import pytest

from millrace.llm import decontaminate
from millrace.llm.components import Scratch
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for item, text in items:
        words = split(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        words, hit, found = split(text), set(), set()
        for window, named in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= named
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(awkward_rows):
    rng = random.Random(8)
    texts = dict(awkward_rows)
    cut = [" ".join(texts[i].split()[5:5 + n]) for i, n in ((3, 10), (4, 15), (5, 9), (6, 30))]
    return [
        (1, cut[0].upper().replace("É", "é").replace("Ü", "ü")), (2, f"{prose(rng, 8)} {cut[1]} tail"), (3, cut[2]), (30, cut[3]), (4, "the"), (5, "two"),
        (6, None), (7, ""), (8, "?!"), (9, prose(rng, 40)), (9, prose(rng, 12)), (None, cut[0]), (1, cut[0]), (10, "x x x x x x x x x x x x")]


def test_report_equals_brute_force(spark, awkward, awkward_rows, items):
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, words string")
    got = decontaminate.report(awkward, benchmark).drop("n_near").collect()
    want = brute(awkward_rows, [x for x in items if x[0] is not None])
    assert sorted(map(tuple, got), key=str) == want
    clean = decontaminate.drop_contaminated(awkward, benchmark)
    assert clean.columns == awkward.columns
    # Each row by its own text: two rows without an id, of which one is contaminated.
    named = [x for x in items if x[0] is not None]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(row[0]) for row in awkward_rows if not brute([row], named)[0][-1])


def test_large_benchmarks_are_joined_without_a_broadcast(spark, awkward, awkward_rows, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(awkward, benchmark).drop("n_near").collect()
    assert sorted(map(tuple, got), key=str) == brute(awkward_rows, [x for x in items if x[0] is not None])


def test_rows_that_share_an_id_are_judged_each_by_its_own_text(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {leak} on"), (None, "a clean text"), (None, "another"), (5, leak), (5, "clean too"), (6, "clean"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    near = {(r["doc_id"], r["n_words"]): r["n_near"] for r in decontaminate.report(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()}
    assert near[None, 12] == 1 and near[None, 3] == 0 and near[5, 2] == 0


def test_proximity(spark):
    filler = " ".join(["and"] * 30)
    docs = spark.createDataFrame([
        (1, f"and alpha and beta and gamma {filler}"), (2, f"alpha {filler} beta {filler} gamma"), (3, f"gamma beta and and alpha {filler}"), (4, "alpha")],
        "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "alpha beta gamma and and"), (8, "alpha")], "item_id long, text string")
    room = Scratch(spark, "test")
    items = decontaminate.items_of(benchmark)
    index = decontaminate.build_index(docs, items, room)
    _, rarest = decontaminate.rare_terms(index, items, room)
    near = decontaminate.proximity(index, items, rarest, 10).collect()
    assert sorted(map(tuple, near)) == [(7, 1), (7, 3), (8, 1), (8, 2), (8, 3), (8, 4)]


def test_empty_tables(spark, awkward, awkward_rows, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(awkward, none).drop("n_near").collect()), key=str) == brute(awkward_rows, [])
    assert decontaminate.report(nothing, none).collect() == []
    assert decontaminate.report(nothing, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_main_path_is_native(spark, awkward, items):
    plan = decontaminate.report(awkward, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_texts_without_a_find_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more") for i in range(50)] + [(50, "a b c d"), (50, "a b c d"), (None, None)], "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame([("x", "b c")], "item_id string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "doc_words" not in " ".join(x for x in plan.split("\n") if "SortMergeJoin" in x)
    rows = sorted((r.doc_id or 0, r.n_words, len(r.hits)) for r in found.collect())
    assert len(rows) == 53 and rows[-2:] == [(50, 4, 1)] * 2 and (0, 0, 0) in rows and sum(r[2] for r in rows) == 2
