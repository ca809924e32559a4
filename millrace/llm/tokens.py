"""Whole texts to ids with the tokenizers library, each distinct stretch of a text encoded once.

Neither kind of vocabulary has a token that goes on from a non-blank to a blank, or from a letter to an ASCII mark: their
patterns split there, and the normal forms they use don't join characters across it. So a text's ids are those of its
stretches in order, and stretches come again and again. Texts are cut as UTF-8 bytes, in numpy, and Arrow tells the
distinct stretches of some texts, so only these are looked at one by one. A worker keeps the ids of the stretches it has seen,
in two lists of some `MAX_KEPT`: when the newer one is full it takes the place of the older one, out of which what comes
again moves over. A new stretch of Latin letters alone goes straight to the vocabulary's model, as its pattern would
leave it whole; all other new ones take the library's whole way. Which of two spellings the model wants (leading blank
kept, or dropped with letters lowered) is probed once; if neither gives the library's ids, all stretches go the whole way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.words import FORGET

MAX_KEPT = 500_000

#: Characters that Unicode calls white space: those of a byte, and the last three bytes of all others.
BLANKS = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
WIDE_BLANKS = [int.from_bytes(x.encode()[-3:], "big") for x in "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
LATIN_BLANKS = [int.from_bytes(x.encode(), "big") for x in "\x85\xa0"]

#: Latin letters that are one character in every normal form used, and ASCII characters no pattern joins to a letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
ASCII_LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARKS = np.isin(np.arange(256), [i for i in range(33, 127) if not chr(i).isalnum()])
PROBES = [" the", "Word", " \u00dcber", "\u00e9\u00c9\u00e8", "x", " na\u00efve", " thereWith", "stra\u00dfe"]


def _byte_letters(text: str) -> str:
    """The text with each byte as the character that stands for it in byte-level vocabularies."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)


# Bytes that Latin-1 can't print, in order, are the characters from 256 on.
_UNPRINTABLE = [*range(0, 33), *range(127, 161), 173]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_UNPRINTABLE)}


def _with_blank(text: str) -> str:
    return _byte_letters(text).replace(" ", "\u0120")


def _lowered(text: str) -> str:
    return _byte_letters(text.strip().lower())


_TOKENIZERS: dict[str, Encoder] = {}


class Encoder:
    """One vocabulary in one worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.simple = re.compile(f" ?[{LETTERS}]+").fullmatch
        self.spelling = next((f for f in (_with_blank, _lowered) if self._fits(f)), None)

    def _fits(self, spelling: Callable[[str], str]) -> bool:
        return all(
            [x.id for x in self.tokenizer.model.tokenize(spelling(text))] == self.tokenizer.encode(text, add_special_tokens=False).ids
            for text in PROBES)

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches, which are kept."""
        if len(self.kept) > MAX_KEPT:
            self.kept, self.older = {}, self.kept
        ids = list(map(self.kept.get, stretches))
        new = [i for i, found in enumerate(ids) if found is None]
        for i in new if self.older else ():
            ids[i] = self.older.get(stretches[i])
        if self.spelling:
            tokenize, spelling, simple = self.tokenizer.model.tokenize, self.spelling, self.simple
            for i in new:
                if ids[i] is None and simple(stretches[i]):
                    ids[i] = array("I", [x.id for x in tokenize(spelling(stretches[i]))]).tobytes()
        rest = [i for i in new if ids[i] is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([stretches[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = array("I", found.ids).tobytes()
        self.kept.update((stretches[i], ids[i]) for i in new)
        return ids

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """For each text its ids and then the id `end`, as little-endian unsigned 32-bit integers."""
        stretches, first = cut(texts)
        found = stretches.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*self._ids(names), np.array([end], dtype="<u4").tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place, known = np.cumsum(size) - size, np.frombuffer(b"".join(ids), dtype="<u4")
        # Ends go behind the last stretch of each text.
        order = np.insert(found.indices.to_numpy(), first[1:], len(names))
        n = size[order]
        after = np.cumsum(n)
        raw = known[np.repeat(place[order] - (after - n), n) + np.arange(after[-1] if len(after) else 0)].tobytes()
        cuts = [0, *(4 * after[first[1:] + np.arange(len(texts))]).tolist()]
        return [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts in order, and which is the first of each text, with their number at the end.

    A stretch begins at an ASCII blank behind what is no blank, as some patterns join a blank to the next word, and at an
    ASCII mark behind a letter.
    """
    column = pa.array(texts, pa.large_string())
    _, offsets, buffer = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[:len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[:bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
    blank, letter = BLANKS[data], ASCII_LETTERS[data]
    latin = np.flatnonzero(data == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    letter[latin] = letter[latin + 1] = True
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = blank[1:] & ~blank[:-1] | MARKS[data[1:]] & letter[:-1]
    # Not behind a blank of more bytes than one.
    wide = np.flatnonzero(begins[1:-1] & (data[:-1] > 0x7F))
    last = data[wide].astype(np.int64) | data[wide - 1].astype(np.int64) << 8
    behind = np.isin(last, LATIN_BLANKS) | np.isin(last | data[np.maximum(wide - 2, 0)].astype(np.int64) << 16, WIDE_BLANKS)
    begins[wide[behind] + 1] = False
    begins[bounds] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    places = pa.py_buffer(np.append(starts, len(data)))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, places, buffer]), first


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


#: The words that are kept take some 200 MB; work that cuts no texts into ids ends the need for them.
FORGET.append(_TOKENIZERS.clear)


def slices(texts: Iterable[str | None], size: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of runs of at most `size` characters, or of one longer text; null is empty."""
    start, room, run = 0, 0, []
    for i, text in enumerate(texts):
        if run and room + len(text or "") > size:
            yield start, run
            start, room, run = i, 0, []
        run.append(text or "")
        room += len(run[-1])
    if run:
        yield start, run
