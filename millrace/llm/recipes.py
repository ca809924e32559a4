r"""Exact duplicates by recipes of content-defined chunks.

A text is normalised (every `[\x20\x09-\x0D]+` becomes one space) and cut into chunks where its own bytes say so: after
eight bytes whose hash starts with CUT_BITS zeros, not under MIN bytes from the last cut, and at MAX bytes at the
latest. So equal texts have equal chunks. A chunk's identifier is a digest of it, and identifiers are verified: every
distinct chunk is moved once (once per task that has it) to where all chunks of its identifier are counted; if two
differ, the digests are made twice as long and taken anew. A document is then the ordered list of its identifiers, its
recipe, of some 16 bytes for 4 KB of text; documents are compared, grouped and joined by recipes alone, and long texts
move no more.

Of equal texts the row with the smallest doc_id stays; a row without a doc_id stays only if no equal text has one. Of
several rows with that doc_id, one stays. Null counts as empty; the empty text is one text, and " " another. Repeated
rows are rows of their own. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.words import SPACE, Texts, pieces

#: Bytes of a chunk: 4 KB on average, and never less (but at the end of a text) or more than these.
CUT_BITS, MIN, MAX = 12, 1 << 10, 1 << 15
WINDOW = 8
DIGEST_BYTES = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with every run of separators as one space, and the borders of the texts."""
    blank = SPACE[texts.data]
    keep = np.ones(len(blank), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[texts.bounds[:-1][np.diff(texts.bounds) > 0]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.where(blank, np.uint8(32), texts.data)[keep], place[texts.bounds]


def marks(data: np.ndarray) -> np.ndarray:
    """The ends of all stretches of WINDOW bytes that ask for a cut, in order."""
    found = []
    for phase in range(WINDOW):
        n = (len(data) - phase) // WINDOW
        if n > 0:
            value = np.frombuffer(data[phase:phase + n * WINDOW].tobytes(), "<u8")
            found.append(np.flatnonzero((value * _ODD) >> np.uint64(64 - CUT_BITS) == 0) * WINDOW + phase + WINDOW)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The places after which each text is cut, its end included; none for an empty text."""
    asked = marks(data)
    inside = np.searchsorted(asked, bounds, side="right")
    out = []
    for low, high, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), inside[:-1].tolist(), inside[1:].tolist(), strict=True):
        ends, last = [], low
        for end in [*asked[i:j].tolist(), high]:
            while end - last > MAX:
                last += MAX
                ends.append(last)
            # A cut is at least MIN from the one before, so its window lies in this text.
            if end == high > last or end < high and end - last >= MIN:
                ends.append(end)
                last = end
        out.append(ends)
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]]]]:
    """Pieces of a partition with the normalised text of each row and its chunks."""
    for part, texts in pieces(batches):
        data, bounds = normalised(texts)
        whole = data.tobytes()
        chunks = []
        for low, ends in zip(bounds[:-1].tolist(), chunk_ends(data, bounds), strict=True):
            chunks.append([whole[a:b] for a, b in itertools.pairwise([low, *ends])])
        yield part, [whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], chunks


def chunks(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """digest, chunk: the chunks of all texts, equal ones of one piece of a partition once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cut in _chunked(batches):
            found = list({chunk for row in cut for chunk in row})
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(c, digest_bytes) for c in found], pa.binary()), pa.array(found, pa.binary())], ["digest", "chunk"])

    return docs.select("text").mapInArrow(work, "digest binary, chunk binary")


def verified(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> int:
    """The length of digests by which no two different chunks of `docs` are the same: `digest_bytes` or some doubling."""
    while True:
        distinct = chunks(docs, digest_bytes).distinct()
        if distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return digest_bytes
        digest_bytes = min(64, 2 * digest_bytes)


def recipes(docs: DataFrame, digest_bytes: int, room: Scratch) -> DataFrame:
    """doc_id, row (a number of its own), recipe (identifiers end to end), text_sha256; stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, cut in _chunked(batches):
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([b"".join(_digest(c, digest_bytes) for c in row) for row in cut], pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "recipe", "text_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, recipe binary, text_sha256 string")
    return room.store(made.withColumn("row", F.monotonically_increasing_id()))


def report(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`."""
    room = Scratch(docs.sparkSession, "recipes")
    listed = recipes(docs, verified(docs, digest_bytes), room)
    groups = listed.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns; of rows equal in doc_id and text any one."""
    key, columns = "__recipe_row", docs.columns
    while key in columns:
        key += "_"
    stays = report(docs).filter("kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s")).distinct()
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    marked = docs.withColumn(key, F.sha2(blank.cast("binary"), 256))
    left = marked.join(stays, marked["doc_id"].eqNullSafe(stays["i"]) & (marked[key] == stays["s"]), "left_semi")
    return left.dropDuplicates(["doc_id", key]).select(*columns)
