r"""What five filters remove, apart and one after the other, in every order.

The filters fail a text that has: A, under 200 words; B, 100 * distinct words < 50 * words; C, 100 * `[A-Z]` characters >
3 * code points; D, any of `[#$%&*|]`; E, a row with a smaller doc_id and the very same text anywhere in the table.
Words are maximal `[^\x20\x09-\x0D]+`.

E is found with a counting Bloom sketch: every partition counts the cells that its texts' hashes fall on, up to two,
the counts are merged slice by slice, and a text with a cell that is counted only once has no equal. Only other texts,
the possible repeats, are shuffled, whole, and reduced to the smallest doc_id of each; partial minimums come first, so a
text that a third of all rows have is one row per task. The sketch has CELLS cells a row, of which one bit each is sent:
at most 2**MAX_BITS / 8 bytes. Beyond 2**MAX_BITS / CELLS rows it keeps that size, clears fewer texts, and more of them
are shuffled; the result is the same.

A row's failures are a mask of five bits. Rows are counted by part, mask and labels, and everything else is a sum over those
counts. Null text and null lang count as empty. A row without a doc_id neither repeats a text nor is repeated. Rows equal in
doc_id and text repeat each other no more than themselves, and each counts. A document is good (toxic) if any of its label
rows says so. An empty table gives no rows. Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.words import blobs, mix

FILTERS = "ABCDE"
#: Cells of the sketch for each row, cells that a text falls on, and the largest sketch: 2**29 cells, 64 MB as bits.
CELLS, MAX_BITS = 8, 29
SLICE_BITS = 20
#: Hashes of a partition that are counted at a time.
COUNTED = 1 << 20
_SALTS = tuple(np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def failures(text: Column) -> Column:
    """The mask of the filters A to D that `text` fails; filter i of FILTERS has bit 2**i."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def sketch_bits(rows: int) -> int:
    return min(MAX_BITS, max(10, math.ceil(math.log2(max(1, CELLS * rows)))))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of every hash, a row for each salt."""
    return np.stack([(mix(hashes.astype(np.uint64) + s) >> np.uint64(64 - bits)).astype(np.int64) for s in _SALTS])


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's cells by slice: places that are hit, and whether more than once."""
    width = min(bits, SLICE_BITS)

    def counted(hashes: np.ndarray) -> pa.RecordBatch:
        hit, n = np.unique(cells(hashes, bits), return_counts=True)
        names, first = np.unique(hit >> width, return_index=True)
        cuts = np.append(first, len(hit))
        return pa.RecordBatch.from_arrays([
            pa.array(names.astype(np.int32)), blobs((hit & ((1 << width) - 1)).astype(np.uint32), cuts),
            blobs((n > 1).astype(np.uint8), cuts)], ["slice", "places", "more"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= COUNTED:
                yield counted(np.concatenate(held))
                held, n = [], 0
        if n:
            yield counted(np.concatenate(held))

    return work


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of a slice added up; two stands for more."""
    size = 1 + max(np.frombuffer(x, np.uint32).max() for x in table["places"].to_pylist())
    total = np.zeros(size, dtype=np.uint8)
    for places, more in zip(table["places"].to_pylist(), table["more"].to_pylist(), strict=True):
        at = np.frombuffer(places, np.uint32)
        total[at] = np.minimum(2, total[at] + 1 + np.frombuffer(more, np.uint8))
    hit = np.flatnonzero(total)
    cuts = np.array([0, len(hit)])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "places": blobs(hit.astype(np.uint32), cuts),
                     "more": blobs((total[hit] > 1).astype(np.uint8), cuts)})


def _bitmap(bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def work(key: tuple, table: pa.Table) -> pa.Table:
        """A bit for every cell of a slice: whether it was counted more than once."""
        found = _merged(key, table)
        places, more = (np.frombuffer(found[name][0].as_py(), kind) for name, kind in (("places", np.uint32), ("more", np.uint8)))
        cell = np.zeros(1 << min(bits, SLICE_BITS), dtype=bool)
        cell[places[more > 0]] = True
        return pa.table({"slice": found["slice"], "bits": pa.array([np.packbits(cell).tobytes()], pa.binary())})

    return work


def repeat_test(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test that is true for every hash that two rows of `hashes` (one long column) have, and for few others."""
    spark = hashes.sparkSession
    counts = hashes.mapInArrow(_counter(bits), "slice int, places binary, more binary")
    # First among a number of partitions, then among what is left of those, so that no task merges what all have sent.
    lanes = max(1, math.isqrt(hashes.rdd.getNumPartitions()))
    lane = counts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).groupBy("slice", "lane")
    merged = lane.applyInArrow(_merged, "slice int, places binary, more binary").groupBy("slice").applyInArrow(
        _bitmap(bits), "slice int, bits binary")
    size = (1 << min(bits, SLICE_BITS)) >> 3
    bitmap = np.zeros((1 << bits) >> 3, dtype=np.uint8)
    for row in merged.toLocalIterator():
        bitmap[row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def repeats(hash: pd.Series) -> pd.Series:
        at = cells(hash.to_numpy().view(np.uint64), bits)
        return pd.Series(((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return repeats


def masks(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, part, mask for every row of `docs`."""
    room = Scratch(docs.sparkSession, "filters")
    text = F.coalesce("text", F.lit(""))
    facts = room.store(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("hash"),
                                   failures(text).alias("mask")))
    known = facts.filter("doc_id IS NOT NULL").select("hash")
    may_repeat = repeat_test(known, bits or sketch_bits(facts.count()))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"))
    first = texts.filter(may_repeat("hash")).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = first.select("doc_id", F.xxhash64("text").alias("hash"), F.lit(True).alias("first"))
    marked = facts.withColumn("may", F.when(F.col("doc_id").isNotNull(), may_repeat("hash")).otherwise(False))
    late = F.col("may") & F.col("first").isNull()
    return marked.join(first, ["doc_id", "hash"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def steps() -> Column:
    """All steps of all orders: an array of (filter_order, step, letter, own bit, bits of the steps before)."""
    found = []
    for order in map("".join, itertools.permutations(FILTERS)):
        earlier = 0
        for i, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            found.append({"filter_order": order, "step": i + 1, "letter": letter, "own": own, "earlier": earlier})
            earlier |= own
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order: string, step: int, letter: string, own: int, earlier: int>>")


def audit(docs: DataFrame, labels: DataFrame, bits: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    counts = masks(docs, bits).join(said, "doc_id", "left").groupBy(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.count(F.lit(1)).alias("n"))
    each = counts.select("part", "mask", "good", "toxic", "n", F.explode(steps()).alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    fails, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long").alias(name)

    out = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~before, "kept"), total(fails & ~before, "removed"), total(fails & before, "redundant"),
        total(F.col("mask") == F.col("own"), "unique_fails"), total(fails & ~before & F.col("good"), "good_lost"),
        total(fails & ~before & F.col("toxic"), "toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).cast("long").alias("shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
