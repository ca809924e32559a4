"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (a hash of the text, doc_id, a number of the row), so equal texts lie together and a shard is a
random mix of the rest. The borders between shards are found by counting: in each round every partition counts the exact bytes between
candidate keys inside the few intervals that hold a border, the intervals narrow to the cell where the wanted number of
bytes is reached, and probing goes on there until a border is near enough or a cell holds a single row. A border inside a
group of equal texts is sought among their doc_ids, and inside one of equal rows among their numbers, so a large group of copies is
split like any other stretch. Then one exchange puts every document in place.

A document's size is the UTF-8 bytes of its text plus 16; a null text has none and goes with equal texts of its kind. A
null doc_id counts as the smallest. Rows equal in text and doc_id are split as any others. No row is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.groups import fresh
from millrace.operators.ordering import number_rows

SHARDS, OVERHEAD = 40, 16
#: Cells an interval is probed at in one round.
PROBES = 4096
_LOW, _HIGH = -(2**63), 2**63 - 1


#: The parts of the sort key, none of which is null.
KEY = ("h", "d", "r")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `docs`, size, and the sort key (h, d, r). `h` is not negative; `r` is settled when the rows are stored."""
    return docs.select(
        *columns, (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("d"),
        F.monotonically_increasing_id().alias("r"))


@dataclass
class Border:
    """A border being sought: `wanted` bytes lie before it, `below` of them before the interval [low, high] of keys.

    The interval is one of the part of the key that comes after those in `prefix`, which are as given there.
    """

    wanted: float
    below: int
    low: int
    high: int
    prefix: tuple[int, ...] = ()
    found: tuple[int, ...] | None = None

    @property
    def interval(self) -> tuple[tuple[int, ...], int, int]:
        return self.prefix, self.low, self.high


def _cells(rows: DataFrame, intervals: list[tuple[tuple[int, ...], int, int]]) -> dict[int, list[tuple]]:
    """By interval: (cell, bytes, rows, smallest key, largest key) in order of cells.

    At most PROBES rows for each interval come to the driver.
    """
    place, cell, value = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, (prefix, low, high) in reversed(list(enumerate(intervals))):
        key = F.col(KEY[len(prefix)])
        within = key.between(low, high)
        for name, part in zip(KEY, prefix, strict=False):
            within = (F.col(name) == part) & within
        width = (high - low) // PROBES + 1
        # Decimals, as the difference of two ids may exceed a long.
        step = F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
        place, cell, value = (F.when(within, x).otherwise(y) for x, y in ((F.lit(i), place), (step, cell), (key, value)))
    counted = rows.select(place.alias("i"), cell.alias("cell"), value.alias("key"), "size").filter("i IS NOT NULL")
    counted = counted.groupBy("i", "cell").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    found: dict[int, list[tuple]] = {}
    for row in sorted(counted.collect()):
        found.setdefault(row["i"], []).append(tuple(row)[1:])
    return found


def _whole(key: tuple[int, ...]) -> tuple[int, ...]:
    """The smallest key that begins so."""
    return key + (_LOW,) * (len(KEY) - len(key))


def _after(key: tuple[int, ...]) -> tuple[int, ...] | None:
    """The smallest key above all that begin so; None if there is none."""
    while key and key[-1] == _HIGH:
        key = key[:-1]
    return _whole((*key[:-1], key[-1] + 1)) if key else None


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = 0.0) -> list[tuple[int, ...]]:
    """The keys that shards 1, 2, ... begin with. A border is at most `tolerance` bytes, or half a row, off."""
    total = rows.agg(F.sum("size")).head()[0] or 0
    borders = [Border(total * i / shards, 0, 0, _HIGH) for i in range(1, shards)] if total else []
    while open_ := [b for b in borders if b.found is None]:
        intervals = list(dict.fromkeys(b.interval for b in open_))
        cells = _cells(rows, intervals)
        for border in open_:
            below = border.below
            for _, size, n, first, last in cells[intervals.index(border.interval)]:
                if below + size < border.wanted:
                    below += size
                    continue
                before, after = border.wanted - below, below + size - border.wanted
                key, end = (*border.prefix, first), _after((*border.prefix, last))
                if min(before, after) <= tolerance or n == 1:
                    border.found = _whole(key) if before <= after or end is None else end
                elif first == last:  # All alike so far: the next part of the key tells them apart.
                    border.prefix, border.below, border.low, border.high = key, below, _LOW, _HIGH
                else:
                    border.below, border.low, border.high = below, first, last
                break
    return sorted(b.found for b in borders)


def shard_of(found: list[tuple[int, ...]], names: Sequence[str] = KEY) -> Column:
    """The shard of a row with its key in the columns `names`: how many splitters are not above it."""
    if not found:
        return F.lit(0)
    listed = F.array(*(F.struct(*(F.lit(x).cast("long").alias(k) for k, x in zip(KEY, key, strict=True))) for key in found))
    own = F.struct(*(F.col(name).alias(k) for k, name in zip(KEY, names, strict=True)))
    return F.size(F.filter(listed, lambda s: s <= own))


def place(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the place in the shard, in key order) of every document."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    rows = Scratch(docs.sparkSession, "shard-keys").store(keyed(docs.select("doc_id", "text", crc), "doc_id", "text_crc32"))
    sharded = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)))
    return number_rows(sharded, KEY, by=["shard"], name="slot").drop(*KEY)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = 0.0) -> None:
    """Write `docs`, all columns, to folders shard=0, shard=1, ... at `path`, each file in key order, by one exchange.

    A column `shard` of `docs` gives way to the folder's. The documents are stored once before, with their key.
    """
    room, columns = Scratch(docs.sparkSession, "shard-rows"), [c for c in docs.columns if c.lower() != "shard"]
    names = [fresh(f"__{k}", columns) for k in KEY]
    rows = room.store(docs.withColumns(dict(zip(names, (F.shiftrightunsigned(F.xxhash64("text"), 1), F.coalesce(
        F.col("doc_id").cast("long"), F.lit(_LOW)), F.monotonically_increasing_id()), strict=True))))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size")
    found = splitters(rows.select(size, *(F.col(n).alias(k) for k, n in zip(KEY, names, strict=True))), shards, tolerance)
    sharded = rows.select(*columns, *names, shard_of(found, names).alias("shard"))
    sharded.repartitionByRange("shard", *names).sortWithinPartitions("shard", *names).drop(*names).write.partitionBy("shard").parquet(path)
    room.drop(rows)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`place` with the law that holds and no grown shard, as shards are not found from a key alone."""
    return place(docs, shards).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
