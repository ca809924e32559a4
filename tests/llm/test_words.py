from __future__ import annotations

import re
import subprocess
import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens
from millrace.llm import words as w

TEXTS = st.lists(st.none() | st.text(st.sampled_from("aB1é\n\t .日|"), max_size=40), min_size=1, max_size=8)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None, max_examples=150)
@given(TEXTS, st.integers(1, 4), st.sampled_from([8, 1 << 18]))
def test_words_lines_and_windows(texts, k, hashed):
    w.HASHED_BYTES = hashed
    found = w.Texts(pa.array(texts, pa.string()))
    for table, pattern, lower in ((w.SPACE, r"[^\x20\x09-\x0D]+", False), (w.PLAIN, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        spans = found.spans(table, lower)
        want = [re.findall(pattern, (t or "").translate(LOWER) if lower else t or "") for t in texts]
        assert spans.counts.tolist() == [len(x) for x in want]
        flat = [word for row in want for word in row]
        assert [bytes(spans.data[i:j]).decode() for i, j in zip(spans.starts, spans.ends, strict=True)] == flat
        hashes = spans.hashes()
        assert len(dict(zip(flat, hashes.tolist(), strict=True))) == len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(hashes.tolist()))
        at, runs = spans.windows(hashes, k)
        windows = [tuple(row[i:i + k]) for row in want for i in range(len(row) - k + 1)]
        assert len(at) == len(windows)
        assert len(set(zip(windows, runs.tolist(), strict=True))) == len(set(windows)) == len(set(runs.tolist()))
    lines = found.spans(w.NEWLINE, keep_empty=True)
    assert [bytes(lines.data[i:j]).decode() for i, j in zip(lines.starts, lines.ends, strict=True)] == [
        line for t in texts for line in (t or "").split("\n")]
    w.HASHED_BYTES = 1 << 18


@pytest.mark.parametrize("size", [1, 10, 10_000])
def test_pieces_cover_all_rows_once(monkeypatch, size):
    monkeypatch.setattr(w, "PIECE_BYTES", size)
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "text": [None if i % 7 == 0 else "x" * (i % 13) for i in range(50)]})
    assert [i for part, _ in w.pieces(iter([batch, batch.slice(0, 0)])) for i in part.column("i").to_pylist()] == list(range(50))


def test_memory_of_a_finished_task_goes_back_to_the_system():
    # In a process of its own, as memory that others have freed would hide what is kept.
    found = subprocess.run([sys.executable, "-c", """
import re
import numpy as np
import pyarrow as pa
from millrace.llm import neardup
from millrace.llm.words import pieces

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng, before = np.random.default_rng(3), held()
batches = (pa.RecordBatch.from_pydict({"text": [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(1200)]}) for _ in range(4))
for part, texts in pieces(batches):
    rows = neardup.sketch(*neardup.shingles(texts), texts.n, 96)
print(held() - before)
"""], capture_output=True, text=True, check=True)
    assert float(found.stdout) < 50


def test_other_work_ends_what_encoders_keep():
    tokens._TOKENIZERS["a file"] = object()
    list(w.pieces(iter([])))
    assert not tokens._TOKENIZERS
