from __future__ import annotations

import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import huffman


def huffman_cost(counts):
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost, n = cost + a[0] + b[0], n + 1
        heapq.heappush(heap, (a[0] + b[0], n))
    return cost


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=300), st.integers(9, 16))
def test_lengths_are_limited_and_best(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1
    if len(counts) > 1:
        cost = (lengths * counts).sum()
        assert cost >= huffman_cost(counts)
        if huffman.code_lengths(np.array(counts), 40).max() <= limit:
            assert cost == huffman_cost(counts)


@pytest.mark.parametrize("symbols", [1, 2, 3, 500, 40_000])
def test_blocks_decode_to_what_was_encoded(symbols):
    rng = np.random.default_rng(symbols)
    ids, counts = np.sort(rng.choice(60_000, symbols, replace=False)), rng.zipf(1.2, symbols).clip(1, 10**8)
    code = huffman.Code(ids, huffman.code_lengths(counts))
    documents = [rng.choice(ids, n, p=counts / counts.sum()).astype("<u4") for n in (1, 63, 64, 65, 128, 1000)]
    parts = huffman.encode(documents, *code.encoding())
    shift = np.cumsum([0] + [8 * len(x) for x, _ in parts[:-1]])
    marks = np.concatenate([m.astype(np.int64) + s for (_, m), s in zip(parts, shift, strict=True)])
    found = huffman.decode(b"".join(x for x, _ in parts), marks, np.array([len(x) for x in documents]), code.bits, *code.decoding())
    assert (found == np.concatenate(documents)).all()


def test_files_give_back_every_document(spark, awkward, awkward_rows, vocabulary, folder, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = [(doc, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")) for doc, text in awkward_rows]
    huffman.write_token_files(awkward, vocabulary("byte_bpe_50k.json"), 2, f"{folder}/files")
    rows = huffman.read_token_files(spark, f"{folder}/files").collect()
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows) == sorted((str(i), x.tobytes()) for i, x in want)
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in rows]
    assert ids == sorted(ids)


def test_round_trip_and_empty_table(awkward, nothing, vocabulary):
    rows = huffman.round_trip(awkward, vocabulary("byte_bpe_50k.json")).collect()
    assert {r["ids_crc32"] for r in rows if r["doc_id"] in (400, 401, 406)} == {zlib.crc32(np.array([2], "<u4").tobytes())}
    assert huffman.round_trip(nothing, vocabulary("byte_bpe_50k.json")).collect() == []


def test_ids_are_counted_where_they_are_made(awkward, vocabulary):
    rows = huffman.token_rows(awkward, vocabulary("byte_bpe_50k.json"), 2)
    made = rows.collect()
    assert 0 < sum(r["counts"] is not None for r in made) < len(made)
    want = np.bincount(np.frombuffer(b"".join(r["ids"] for r in made), "<u4"))
    ids, counts = huffman.id_counts(rows.select("counts"))
    assert ids.tolist() == np.flatnonzero(want).tolist() and counts.tolist() == want[ids].tolist()
