"""Packing of documents into sequences of a fixed length, by patterns of few documents.

The histogram of piece lengths is all that packing looks at; it has `capacity` bins however many documents there are.
Patterns are short lists of lengths that fill a sequence: two lengths, or three or four with repeats. Repeat counts are
the non-negative least-squares fit of the patterns to the histogram, rounded down. What they leave is packed best-fit,
longest first, by counts of equal pieces. The result is a plan of runs, "the pieces of length l with ranks from r on are
the j-th in the sequences from s on", that is joined to the ranked pieces.

Documents longer than a sequence are cut; no other is. Null and empty texts have one id, the end. Repeated rows are
packed as documents of their own. The plan depends on the histogram alone; ranks order equal lengths by doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.tokens import encoder, slices
from millrace.llm.words import trim
from millrace.operators.ordering import number_rows

CAPACITY = 2048
#: Patterns that are offered to the fit, and steps of the fit.
MAX_PATTERNS, FIT_STEPS = 60_000, 400


def piece_rows(docs: DataFrame, vocabulary: str, end: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may be a task's whole input, so its texts are taken out as they are needed.
            for at, texts in slices(x.as_py() for x in batch.column("text")):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for i, found in enumerate(encoder(vocabulary).encode(texts, end)):
                    for j, low in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[low:low + 4 * capacity]
                        row.append(at + i)
                        piece.append(j)
                        start.append(low // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        data.append(part)
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * ids, names)
                trim()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def patterns(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Lists of two to four lengths that fill a sequence, from lengths the histogram has; one array for each size."""
    have = counts > 0
    have[capacity] = False
    lengths = np.flatnonzero(have)
    if not len(lengths):
        return []
    common = lengths[np.argsort(-counts[lengths], kind="stable")]
    low, rest = lengths[lengths <= capacity // 2], capacity - lengths[lengths <= capacity // 2]
    found = [np.stack([low[have[rest]], rest[have[rest]]], axis=1)]
    for size, limit in ((3, MAX_PATTERNS), (4, MAX_PATTERNS // 2)):
        # The most frequent lengths with each other, and the length that fills the sequence.
        some = np.sort(common[:max(2, int((limit * 2) ** (1 / (size - 1))))])
        grid = np.stack(np.meshgrid(*[some] * (size - 1), indexing="ij"), axis=-1).reshape(-1, size - 1)
        grid = grid[(np.diff(grid, axis=1) >= 0).all(axis=1)]
        last = capacity - grid.sum(axis=1)
        fits = (last >= grid[:, -1]) & have[np.clip(last, 0, capacity)]
        found.append(np.column_stack([grid[fits], last[fits]])[:limit])
    return [x for x in found if len(x)]


def fit(counts: np.ndarray, offered: list[np.ndarray], steps: int = FIT_STEPS) -> list[np.ndarray]:
    """Non-negative repeat counts that come nearest to the histogram, by accelerated projected gradients."""
    rows = [p.ravel() for p in offered]
    column = np.concatenate([np.repeat(np.arange(len(p)), p.shape[1]) + sum(len(q) for q in offered[:i]) for i, p in enumerate(offered)])
    row, n = np.concatenate(rows), sum(len(p) for p in offered)
    # The largest eigenvalue is at most the largest sum of a row times the largest of a column.
    bound = np.bincount(row).max() * max(p.shape[1] for p in offered)
    x = y = np.zeros(n)
    momentum = 1.0
    for _ in range(steps):
        miss = np.bincount(row, weights=y[column], minlength=len(counts)) - counts
        moved = np.maximum(0.0, y - np.bincount(column, weights=miss[row], minlength=n) / bound)
        further = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = moved + (momentum - 1) / further * (moved - x)
        x, momentum = moved, further
    return np.split(np.floor(x + 1e-6).astype(np.int64), np.cumsum([len(p) for p in offered])[:-1])


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) of runs that cover counts[length] pieces of each length."""
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n

    if left[capacity]:
        sequences = int(left[capacity])
        place(capacity, sequences, 0, 0)
    offered = patterns(left, capacity)
    if offered:
        for chosen, repeats in zip(offered, fit(left.astype(float), offered), strict=True):
            for i in np.flatnonzero(repeats):
                lengths = chosen[i].tolist()
                n = min(int(repeats[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
                if n:
                    offset = 0
                    for length in lengths:
                        place(length, n, sequences, offset)
                        offset += length
                    sequences += n
    # Best fit, longest first. Sequences in use are runs (first, how many) by the room they have left.
    room: dict[int, list[tuple[int, int]]] = {}
    for length in range(capacity, 0, -1):
        while left[length]:
            wide = min((x for x in room if x >= length), default=None)
            if wide is None:
                n = -(-int(left[length]) // (capacity // length))
                room.setdefault(capacity, []).append((sequences, n))
                sequences += n
                continue
            first, n = room[wide].pop()
            each = wide // length  # As many as fit, in all but the last sequences of the run.
            full = min(n, int(left[length]) // each)
            if full:
                for i in range(each):
                    place(length, full, first, capacity - wide + i * length)
                taken = each * length
            else:
                full, taken = 1, int(left[length]) * length
                for i in range(int(left[length])):
                    place(length, 1, first, capacity - wide + i * length)
            if wide - taken:
                room.setdefault(wide - taken, []).append((first, full))
            if n > full:
                room[wide].append((first + full, n - full))
            if not room[wide]:
                del room[wide]
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """`pieces` (with a column `length` from 1 to `capacity`) and for each its sequence_id and offset.

    The histogram, at most `capacity` rows, is collected; the plan has a few rows for each length and is broadcast.
    """
    spark = pieces.sparkSession
    ranked = number_rows(pieces, order, by=["length"], name="__rank")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in ranked.groupBy("length").count().collect():
        counts[length] = n
    rows = plan(counts, capacity)
    runs = spark.createDataFrame(
        pa.table(dict(zip(("__length", "__first", "__n", "__sequence", "offset"), (pa.array(x, pa.int64()) for x in np.array(rows, dtype=np.int64).reshape(-1, 5).T), strict=True))))
    inside = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n"))
    joined = ranked.join(F.broadcast(runs), (ranked["length"] == runs["__length"]) & inside)
    return joined.select(*pieces.columns, (F.col("__sequence") + F.col("__rank") - F.col("__first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # Stored, as ranking reads its input more than once.
    return pack(Scratch(docs.sparkSession, "pieces").store(piece_rows(docs, vocabulary, end, capacity)), capacity)
