"""Token ids in files: canonical length-limited Huffman codes, independent blocks, checkpoints of bit offsets.

A file set is a folder with two Parquet tables. `codes` holds (id, bits): canonical codes follow from the lengths, in
order of (bits, id). `blocks` holds, in ascending doc_id order, (part, block, start, doc_ids, sizes, checkpoints,
payload): whole documents until BLOCK_IDS ids are reached; `start` counts the part's ids before the block; `payload` is
the documents' bits, each document from a new byte; `checkpoints` has the bit offset of every CHECKPOINT-th id of every
document. A block is read alone: all its checkpoints are decoded side by side, one table look-up per id.

Null and empty texts have one id, the end. Repeated rows are documents of their own; a null doc_id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.tokens import encoder, slices
from millrace.session import scratch_path

MAX_BITS, CHECKPOINT, BLOCK_IDS = 16, 64, 1 << 16
#: Ids that a task encodes at a time, or one longer document.
ENCODED_IDS = 1 << 18


def token_rows(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, `end` last) of every document, and `counts`: of some documents,
    beside the first of them, the ids in use and how often each occurs (binary, 64-bit pairs).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text").to_pylist()):
                ids = encoder(vocabulary).encode(texts, end)
                total = np.bincount(np.frombuffer(b"".join(ids), dtype="<u4"))
                used = np.flatnonzero(total)
                counts = [np.stack([used, total[used]]).astype("<i8").tobytes()] + [None] * (len(ids) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                    ["doc_id", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use and how often each occurs in all `token_rows`; at most a vocabulary of rows is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            pairs = [np.frombuffer(x, "<i8").reshape(2, -1) for x in batch.column("counts").to_pylist()]
            some, n = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
            found = np.zeros(max(len(total), int(some.max(initial=-1)) + 1), dtype=np.int64)
            np.add.at(found, some, n)
            found[:len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    table = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return table["id"].to_numpy(), table["n"].to_numpy()


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The lengths of an optimal prefix code with no length over `limit`, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    rows, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        rows.append(rank < n)  # Which of the level's items, by weight, are leaves.
        merged = weights[rank]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for row in reversed(rows):
        chosen = int(row[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ids, from their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        # The first code of each length, left-aligned in `bits` bits, goes on where the shorter ones end.
        spans = np.left_shift(np.int64(1), self.bits - self.lengths)
        self.aligned = np.cumsum(spans) - spans
        self.spans = spans

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, length) by id."""
        size = int(self.ids.max(initial=0)) + 1
        code, length = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.int64)
        code[self.ids] = self.aligned >> (self.bits - self.lengths)
        length[self.ids] = self.lengths
        return code, length

    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) by the next `bits` bits."""
        symbol, length = np.zeros(1 << self.bits, dtype=np.uint32), np.ones(1 << self.bits, dtype=np.int64)
        used = int(self.spans.sum())
        symbol[:used] = np.repeat(self.ids, self.spans)
        length[:used] = np.repeat(self.lengths, self.spans)
        return symbol, length


def encode(documents: list[np.ndarray], code: np.ndarray, length: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """(bits from a new byte, bit offsets of every CHECKPOINT-th id) of each document."""
    sizes = np.array([len(x) for x in documents])
    ids = np.concatenate(documents)
    bits = length[ids]
    after = np.cumsum(bits)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ends = after[first[1:] - 1]
    begins = np.concatenate([[0], ends[:-1]])
    size_bytes = (ends - begins + 7) // 8
    base = np.concatenate([[0], np.cumsum(size_bytes)])
    inside = after - bits - np.repeat(begins, sizes)
    at = inside + np.repeat(base[:-1] * 8, sizes)
    word = code[ids].astype(np.uint64) << (np.uint64(40) - (at & 7).astype(np.uint64) - bits.astype(np.uint64))
    out = np.zeros(base[-1] + 5, dtype=np.uint8)
    place = at >> 3
    for i in range((int(length.max()) + 14) // 8):
        part = ((word >> np.uint64(32 - 8 * i)) & np.uint64(255)).astype(np.uint8)
        np.add.at(out, (place + i)[part > 0], part[part > 0])
    raw = out.tobytes()
    return [(raw[base[i]:base[i + 1]], inside[first[i]:first[i + 1]:CHECKPOINT].astype("<u4")) for i in range(len(documents))]


def decode(payload: bytes | pa.Buffer, checkpoints: np.ndarray, sizes: np.ndarray, bits: int, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All ids of a block, document after document, from the bit offset of every checkpoint."""
    raw = np.concatenate([np.frombuffer(payload, dtype=np.uint8), np.zeros(5, dtype=np.uint8)])
    # At every byte, the next bytes that a code beginning in it may reach.
    reach = (bits + 14) // 8
    kind = np.uint32 if reach <= 4 else np.uint64
    window = np.zeros(len(raw) - reach + 1, dtype=kind)
    for i in range(reach):
        window |= raw[i:len(raw) - reach + 1 + i].astype(kind) << kind(8 * (reach - 1 - i))
    runs = -(-sizes // CHECKPOINT)
    want = np.full(int(runs.sum()), CHECKPOINT)
    want[np.cumsum(runs) - 1] = sizes - (runs - 1) * CHECKPOINT
    start = np.cumsum(want) - want
    ids, at = np.zeros(int(sizes.sum()), dtype="<u4"), checkpoints.astype(np.int64)
    order = np.argsort(-want, kind="stable")  # Runs that end early drop off the end.
    at, start, want = at[order], start[order], want[order]
    mask = kind((1 << bits) - 1)
    for i in range(int(want.max(initial=0))):
        n = int(np.searchsorted(-want, -i, side="left"))
        at, start, want = at[:n], start[:n], want[:n]
        peek = (window[at >> 3] >> (8 * reach - bits - (at & 7)).astype(kind)) & mask
        ids[start + i] = symbol[peek]
        at = at + length[peek]
    return ids


def write_token_files(docs: DataFrame, vocabulary: str, end: int, path: str) -> None:
    """Encode every text of `docs` into a file set at `path`, in ascending doc_id order."""
    spark = docs.sparkSession
    room = Scratch(spark, "tokens")
    tokens = room.store(token_rows(docs, vocabulary, end))
    ids, counts = id_counts(tokens)
    lengths = code_lengths(counts)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "bits": pa.array(lengths, pa.int64())})).coalesce(1).write.parquet(f"{path}/codes")
    kind = dict(docs.dtypes)["doc_id"]
    table = Code(ids, lengths)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = table.encoding()
        for batch in batches:
            column, at = batch.column("ids"), 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < ENCODED_IDS):
                    part.append(np.frombuffer(column[at + len(part)].as_buffer(), dtype="<u4"))
                    size += len(part[-1])
                found = encode(part, code, length)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(part)), pa.array([len(x) for x in part], pa.int64()),
                    pa.array([x for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary()),
                ], ["doc_id", "size", "bits", "checkpoints"])
                at += len(part)

    encoded = tokens.select("doc_id", "ids").mapInArrow(to_bits, f"doc_id {kind}, size long, bits binary, checkpoints binary")
    # Ranges are sampled from the ids alone; rows are sorted and laid out with the number of their part.
    bounds = doc_ranges(tokens)
    ranged = encoded.withColumn("part", bounds)
    ordered = ranged.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held = None, 0, 0, []

        def flush() -> pa.RecordBatch:
            sizes = [x[1] for x in held]
            shift = np.cumsum([0] + [8 * len(x[2]) for x in held[:-1]])
            marks = b"".join((np.frombuffer(x[3], "<u4").astype("<u8") + s).tobytes() for x, s in zip(held, shift.astype("<u8"), strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()),
                pa.array([sum(sizes)], pa.int64()), pa.array([[x[0] for x in held]], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([marks], pa.binary()), pa.array([b"".join(x[2] for x in held)], pa.binary()),
            ], ["part", "block", "start", "n", "doc_ids", "sizes", "checkpoints", "payload"])

        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "size", "bits", "checkpoints", "part")]
            for i in range(batch.num_rows):
                doc, size, bits, marks, of = (c[i].as_py() for c in columns)
                if held and (of != part or sum_held >= BLOCK_IDS):
                    yield flush()
                    block, start, held = block + 1, start + sum_held, []
                if of != part:
                    part, block, start = of, 0, 0
                sum_held = (sum_held if held else 0) + size
                held.append((doc, size, bits, marks))
        if held:
            yield flush()

    ordered.mapInArrow(
        blocks, "part int, block long, start long, n long, doc_ids array<long>, sizes array<long>, checkpoints binary, payload binary"
    ).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    room.drop(tokens)


def doc_ranges(rows: DataFrame):
    """A column: the number of the doc_id range a row is in, as many ranges as shuffle partitions, of like row counts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    cuts = F.array(*(F.lit(int(x)) for x in cuts)).cast("array<long>")
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))), F.lit(0))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of every document of a file set.

    With `digest` the CRC-32 of the ids, as ids_crc32, in place of them. The total of every part, one row each, is all
    that is collected.
    """
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    table = Code(codes["id"].to_numpy(), codes["bits"].to_numpy())
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    before, base = 0, {}
    for row in sorted(parts, key=lambda x: x["part"]):
        base[row["part"]] = before
        before += row["n"]
    last = "ids_crc32" if digest else "ids"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length = table.decoding()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("part", "start", "doc_ids", "sizes", "checkpoints", "payload")}
                sizes = row["sizes"].values.to_numpy()
                marks = np.frombuffer(row["checkpoints"].as_buffer(), dtype="<u8")
                found = decode(row["payload"].as_buffer(), marks, sizes, table.bits, symbol, length).tobytes()
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                starts = base[row["part"].as_py()] + row["start"].as_py() + cuts[:-1]
                texts = (found[4 * a:4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
                ids = pa.array([zlib.crc32(x) for x in texts], pa.int64()) if digest else pa.array(list(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(starts), pa.array(sizes), ids], ["doc_id", "start", "n_tokens", last])

    return blocks.mapInArrow(work, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written for it."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, vocabulary, end, path)
    return read_token_files(spark, path, digest=True)
