"""Passages that repeat across documents, found by level-wise doubling of window lengths.

A passage of `length` words repeats if the same words start in a document with a smaller doc_id. Levels have the
lengths `start`, twice `start`, and so on up to `length`. At the first level each window of the second length is stood
for by the smallest hash of the `start`-word windows in it, so a quarter of all windows is enough to miss none. Windows
found in two documents at one level are alone extended to the next: a window there is a candidate only if its two ends
(which overlap if the length is not doubled in full) both repeat. A level without survivors leaves later ones empty.

Rows are dealt into groups by a hash of all their columns, about GROUP_BYTES of text each. A group asks about each of its
distinct windows once, so a window that every document has is one row per group, not per document. Windows go to
buckets by hash; a bucket answers which of its windows two documents have, and which document is the first.

Windows are known by 64-bit hashes: two different windows of a corpus of n words are taken for equal with a
probability of n / 2**64 per window. Null and empty texts have no words. Rows with the same doc_id are one document's:
neither is smaller. A row with a null doc_id keeps all words, and no other row loses any for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm.groups import dealt, fresh, repeated
from millrace.llm.words import SPACE, Spans, Texts, blobs, joined, release

LENGTH, START = 13, 7
GROUP_BYTES = 4 << 20
#: Buckets of windows for each shuffle partition.
BUCKETS_PER_PARTITION = 2

_NO_DOC = -(2**63)


def levels(length: int, start: int) -> list[int]:
    """The lengths of the levels: doubled from `start`, the last one `length`."""
    found = [min(start, length)]
    while found[-1] < length:
        found.append(min(2 * found[-1], length))
    return found


def _first_docs(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the smallest `first` and largest `last` of each."""
    if not len(hashes):
        return hashes, first, last
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[start], np.minimum.reduceat(first[order], start), np.maximum.reduceat(last[order], start)


class _Group:
    """The words of a group of documents, and the windows a level asks about."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.batch = batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        docs = batch.column("doc_id").cast(pa.int64())
        self.known = docs.is_valid().to_numpy(zero_copy_only=False)
        self.docs = docs.fill_null(_NO_DOC).to_numpy(zero_copy_only=False)
        self.texts = Texts(batch.column("text"))
        self.words: Spans = self.texts.spans(SPACE)
        self.hashes = self.words.hashes()

    def anchors(self, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, smallest hash of a `start`-word window inside) of every window of `length` words."""
        at, inner = self.words.windows(self.hashes, start)
        at_long, _ = self.words.windows(self.hashes, length)
        place = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        place[at] = np.arange(len(at))
        low, width = inner, 1
        while 2 * width <= length - start + 1:
            low = np.minimum(low[:len(low) - width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        base = place[at_long]
        rest = length - start + 1 - width
        return at_long, np.minimum(low[base], low[base + rest]) if len(at_long) else inner[:0]

    def candidates(self, lengths: list[int], level: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of a level that the level before it leaves."""
        at, hashes = self.words.windows(self.hashes, lengths[level])
        if level == 1:
            _, inner = self.anchors(lengths[0], lengths[1])
            kept = np.isin(inner, repeated)
        else:
            before, inner = self.words.windows(self.hashes, lengths[level - 1])
            found = np.zeros(len(self.hashes) + 1, dtype=bool)
            found[before[np.isin(inner, repeated)]] = True
            kept = found[at] & found[at + lengths[level] - lengths[level - 1]]
        return at[kept], hashes[kept]

    def ask(self, key: int, at: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.Table:
        """A row per bucket: distinct hashes, the first document of each and the last."""
        doc = self.docs[self.words.text[at]]
        valid = self.known[self.words.text[at]]
        hashes, first, last = _first_docs(hashes[valid], doc[valid], doc[valid])
        bucket = (hashes % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        names, cuts = np.unique(bucket[order], return_index=True)
        cuts = np.append(cuts, len(bucket)).astype(np.int64)
        # The last document is told by one byte: whether it differs from the first.
        return pa.table({
            "bucket": pa.array(names, pa.int32()), "part": pa.array(np.full(len(names), key), pa.int64()),
            "hashes": blobs(hashes[order], cuts), "first": blobs(first[order], cuts),
            "many": blobs((first != last)[order].astype(np.uint8), cuts)})


_ASKED = "bucket int, part long, hashes binary, first binary, many binary"
_ANSWERED = "part long, hashes binary, first binary"


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """To every group that asked: which of its windows two documents have, and the first of them."""
    hashes, first = joined(table["hashes"], np.uint64), joined(table["first"], np.int64)
    many = joined(table["many"], np.uint8)
    known, low, high = _first_docs(hashes, first, first)
    _, _, inside = _first_docs(hashes, first, many)
    repeated = (low != high) | (inside > 0)
    place = np.searchsorted(known, hashes)
    kept = repeated[place]
    size = np.array([len(x) // 8 for x in table["hashes"].to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)[kept]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int64)
    answers = pa.table({
        "part": table["part"], "hashes": blobs(hashes[kept], cuts), "first": blobs(low[place][kept], cuts)})
    return answers.filter(pa.array(np.diff(cuts) > 0))


def finish_repeats(
    docs: DataFrame, finish: Callable[[_Group, np.ndarray], pa.Table], schema: StructType, length: int = LENGTH, start: int = START
) -> DataFrame:
    """`finish(group, covered)` for every group of documents; `covered` marks the words inside repeated passages.

    `finish` gives a row of `schema` for each row of its group, in order.
    """
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = levels(length, start)
    part, copies = fresh("__part", docs.columns), fresh("__copies", docs.columns)
    grouped = dealt(docs, GROUP_BYTES, part, copies).groupBy(part)

    def first_level(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(table)
        if len(lengths) == 1:
            at, hashes = group.words.windows(group.hashes, lengths[0])
        else:
            at, hashes = group.anchors(lengths[0], lengths[1])
        made = group.ask(key[0].as_py(), at, hashes, buckets)
        del group, at, hashes
        release()
        return made

    asked = grouped.applyInArrow(first_level, _ASKED)
    def extend(level: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def next_level(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            group = _Group(table)
            at, hashes = group.candidates(lengths, level, joined(answers["hashes"], np.uint64))
            made = group.ask(key[0].as_py(), at, hashes, buckets)
            del group, at, hashes
            release()
            return made

        return next_level

    for level in range(1, len(lengths)):
        answered = asked.groupBy("bucket").applyInArrow(_answer, _ANSWERED)
        asked = grouped.cogroup(answered.groupBy("part")).applyInArrow(extend(level), _ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_answer, _ANSWERED)

    def last(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(table)
        known, first = joined(answers["hashes"], np.uint64), joined(answers["first"], np.int64)
        order = np.argsort(known)
        known, first = known[order], first[order]
        at, hashes = group.words.windows(group.hashes, length)
        place = np.searchsorted(known, hashes)
        place[place == len(known)] = 0
        found = (known[place] == hashes) & (first[place] < group.docs[group.words.text[at]]) if len(known) else np.zeros(len(at), bool)
        found &= group.known[group.words.text[at]]
        step = np.zeros(len(group.hashes) + 1, dtype=np.int64)
        step[at[found]] += 1
        step[at[found] + length] -= 1
        made = finish(group, np.cumsum(step)[:-1] > 0).append_column(copies, group.batch.column(copies))
        del group, at, hashes, known, first, order, place, found, step
        release()
        return made

    return repeated(grouped.cogroup(answered.groupBy("part")).applyInArrow(
        last, StructType([*schema, StructField(copies, LongType())])), copies)


def _kept_bytes(group: _Group, covered: np.ndarray, text: int) -> list[tuple[int, int]]:
    first, last = group.words.first[text], group.words.first[text + 1]
    kept = first + np.flatnonzero(~covered[first:last])
    return list(zip(group.words.starts[kept].tolist(), group.words.ends[kept].tolist(), strict=True))


def repeated_words(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words outside repeated passages, joined by one space)."""

    def finish(group: _Group, covered: np.ndarray) -> pa.Table:
        data = group.texts.data.tobytes()
        removed = np.bincount(group.words.text, weights=covered, minlength=group.texts.n).astype(np.int64)
        digests = [
            hashlib.sha256(b" ".join([data[i:j] for i, j in _kept_bytes(group, covered, text)])).hexdigest()
            for text in range(group.texts.n)]
        return pa.table({
            "doc_id": group.batch.column("doc_id"), "n_words": pa.array(group.words.counts), "n_removed": pa.array(removed),
            "kept_sha256": pa.array(digests, pa.string())})

    schema = StructType([
        docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    return finish_repeats(docs.select("doc_id", "text"), finish, schema, length, start)


def cut_repeats(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """`docs` with repeated passages cut out of `text`, all other columns as they are.

    A cut goes from a passage's first word to the next kept word; other text stays byte for byte.
    """
    columns = docs.columns

    def finish(group: _Group, covered: np.ndarray) -> pa.Table:
        data, bounds = group.texts.data.tobytes(), group.texts.bounds
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        text_of = group.words.text
        texts: dict[int, list[tuple[int, int]]] = {}
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while i < j:  # A run may go on into the next text.
                text = int(text_of[i])
                end = min(j, int(group.words.first[text + 1]))
                stop = bounds[text + 1] if end == group.words.first[text + 1] else group.words.starts[end]
                texts.setdefault(text, []).append((int(group.words.starts[i]), int(stop)))
                i = end
        column = group.batch.column("text")
        if not texts:
            return pa.Table.from_batches([group.batch.select(columns)])
        values = column.to_pylist()
        for text, cuts in texts.items():
            at, kept = int(bounds[text]), []
            for low, high in cuts:
                kept.append(data[at:low])
                at = high
            kept.append(data[at:int(bounds[text + 1])])
            values[text] = b"".join(kept).decode("utf-8", "replace")
        out = group.batch.select(columns)
        return pa.Table.from_batches([out.set_column(columns.index("text"), out.schema.field("text"), pa.array(values, column.type))])

    return finish_repeats(docs, finish, docs.schema, length, start)
