from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from millrace.llm import strata

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items):
    docs = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in rows) if w]
    n_docs, words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in queries.items():
        found = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:10])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(awkward_rows):
    texts = dict(awkward_rows)
    return [(1, texts[0]), (2, texts[3].upper()), (3, None), (4, ""), (5, "unknownterm"), (6, "the two"), (7, texts[407][:40_000]), (7, "x one"), (8, "x x x"),
            (None, texts[5]), (9, texts[0] + " " + texts[8]), (9, texts[9]), (10, texts[300])]


@pytest.mark.parametrize("block_docs,group_terms", [(1 << 12, 1 << 13), (3, 40)])
def test_ranks_equal_brute_force(spark, awkward, awkward_rows, items, monkeypatch, block_docs, group_terms):
    monkeypatch.setattr(strata, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(strata, "GROUP_TERMS", group_terms)
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, term string")
    got = sorted(map(tuple, strata.rank(awkward, benchmark).collect()), key=str)
    assert got == brute(awkward_rows, items)


def test_many_equal_scores_go_by_id(spark):
    rows = [(i, "same words here") for i in range(2000, 0, -1)] + [(i + 5000, f"other words {i}") for i in range(200)] + [(None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, strata.rank(docs, spark.createDataFrame([(1, "same"), (2, "words other")], "item_id long, text string")).collect()))
    assert got == sorted(brute(rows, [(1, "same"), (2, "words other")]))


def test_ids_of_other_types(spark):
    rows = [(f"d{i}", f"term{i % 3} and term{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = strata.rank(docs, spark.createDataFrame([("q", "term1 term4")], "item_id string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, [("q", "term1 term4")])


def test_empty_tables(spark, nothing, awkward, items):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert strata.rank(nothing, some).collect() == [] and strata.rank(awkward, none).collect() == [] and strata.rank(nothing, none).collect() == []


def test_blocks_are_of_one_stratum_and_hold_every_term(spark, awkward, awkward_rows):
    index = strata.build_index(awkward)
    held = Counter()
    for row in index.blocks.collect():
        block = strata.Block.read(row.asDict())
        assert len(row["ids"]) <= strata.BLOCK_DOCS
        for i, term in enumerate(block.terms.tolist()):
            first, last = int(block.first_runs(strata.np.array([i]))[0]), int(block.term_runs[i])
            tfs = block.run_tf[first:last].tolist()
            assert tfs == sorted(set(tfs), reverse=True)
            held[term] += int(block.documents_with(strata.np.array([i]))[0])
    df = Counter(t for _, text in awkward_rows for t in set(terms(text)))
    assert sorted(held.values()) == sorted(df.values()) and index.documents == sum(bool(terms(t)) for _, t in awkward_rows)
