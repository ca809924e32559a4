from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, tokens


def sequences(runs):
    found = {}
    for length, first, n, sequence, offset in runs:
        for i in range(n):
            found.setdefault(sequence + i, []).append((offset, length, first + i))
    return found


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=200), st.sampled_from([64, 100]))
def test_a_plan_places_every_piece_without_gaps(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = sequences(packing.plan(counts, capacity))
    placed = sorted((length, rank) for row in found.values() for _, length, rank in row)
    assert placed == sorted((length, rank) for length in set(lengths) for rank in range(lengths.count(length)))
    for row in found.values():
        end = 0
        for offset, length, _ in sorted(row):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(found) == list(range(len(found)))


def test_few_sequences_more_than_needed():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(5.8, 1.0, 20_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    used = len(sequences(packing.plan(counts)))
    assert used <= -(-lengths.sum() // 2048) * 1.002 + 1


def test_fit_finds_the_counts_of_exact_patterns():
    counts = np.zeros(101)
    counts[[30, 70, 50]] = [400, 400, 600]
    offered = packing.patterns(counts.astype(int), 100)
    repeats = packing.fit(counts, offered)
    left = counts.copy()
    for rows, n in zip(offered, repeats, strict=True):
        np.subtract.at(left, rows.ravel(), np.repeat(n, rows.shape[1]))
    assert (left >= -1).all() and left.sum() < 20


def test_documents_are_cut_only_if_longer(awkward, awkward_rows, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for doc, text in awkward_rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(doc, i, low, len(ids[low:low + 2048]), zlib.crc32(ids[low:low + 2048].tobytes())) for i, low in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack_documents(awkward, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in places.values():
        row.sort()
        assert [o for o, _ in row] == np.cumsum([0] + [n for _, n in row[:-1]]).tolist()
        assert sum(n for _, n in row) <= 2048


def test_empty_table(nothing, vocabulary):
    assert packing.pack_documents(nothing, vocabulary("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(deadline=None, max_examples=200)
@given(text=st.text(max_size=60) | st.text(st.sampled_from("aB'sé ́\n\t .,|1日Σİ  \x1c\x85"), max_size=40))
def test_stretches_give_the_ids_of_the_whole(name, text):
    path = f"/opt/tokenizers/{name}"
    whole = tokens.encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(path).encode([text], 7)[0], "<u4").tolist() == [*whole, 7]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equal_stretches_of_some_texts_are_looked_up_once(name, vocabulary):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

        def __getitem__(self, key):
            Counted.asked += 1
            return dict.__getitem__(self, key)

    found = tokens.Encoder(vocabulary(name))
    found.kept = Counted()
    texts = ["one two, three"] * 200 + ["", "  one　 two"]
    assert found.encode(texts, 7) == [x for t in texts for x in tokens.encoder(vocabulary(name)).encode([t], 7)]
    assert Counted.asked < 20


def test_stretches_begin_at_blanks_and_at_marks_behind_letters():
    stretches, first = tokens.cut(["a-b  c", "", "é, ×, x", "  y  z　 (5)", " "])
    assert stretches.to_pylist() == ["a", "-b", "  c", "é", ",", " ×,", " x", "  y", "  z　 (5)", " "]
    assert first.tolist() == [0, 3, 3, 7, 9, 10]
