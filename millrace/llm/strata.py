r"""Ranked lexical search over a length-stratified index.

Terms are maximal `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lowered. N documents have terms, L terms in all with
repeats. A document of n terms has the normaliser m = 10 + (90 n N) div L, and documents of one m are a stratum. A term
that df documents hold weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and tf occurrences of it in a document of stratum m
have the impact (10^9 tf) div (1000 tf + 8m); a document's score is the sum of w times impact over a query's terms.

The index holds every term of every document. Rows are range-partitioned and sorted by m, which spreads a stratum that many
documents are in, and cut into blocks of one stratum, of at most BLOCK_DOCS documents and about BLOCK_WORDS different terms
of documents. A block is one row: terms, and for each the postings by falling tf, so an impact is worked out once for each
tf of a block. A term's first tf bounds its impact in the block, and the sum of a query's bounds is that of its score.

Queries are taken in groups of about GROUP_TERMS terms. A group first reads how many documents have its terms, then the
bounds: the SEEDS blocks with the highest bound of each query are scored first, and their tenth best score is what a block's
bound must reach for the block to be visited at all. A task visits blocks by falling bounds and raises that
limit as it finds better documents, and gives back ten documents a query.

Terms are known by 64-bit hashes (two of n different terms are taken for equal with a probability of n / 2**64 each). Null and
empty texts have no terms and are found by no query. Repeated rows of documents are documents of their own; equal scores
go by ascending doc_id, null last. Rows of one item_id are one query with the terms of all; null is an item_id too. Queries
without terms, or whose terms no document has, have no rows; nor has an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.components import Scratch, rows_at_a_time
from millrace.llm.words import PLAIN, Texts, blobs, pieces

TOP = 10
BLOCK_DOCS, BLOCK_WORDS = 1 << 12, 1 << 17
GROUP_TERMS, SEEDS = 1 << 13, 4
#: Documents of a block that are scored at a time, and results of a task that are held before they are reduced.
SCORED, HELD = 1 << 10, 1 << 14
#: Rows of documents and blocks that are handed to a task at a time, and bytes of a row group of the stored index.
READ_ROWS, READ_BLOCKS, ROW_GROUP = 1 << 10, 1 << 4, 1 << 24


def _counted(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of all different terms, by text and term, and the number of terms of each text."""
    words = texts.spans(PLAIN, lower=True)
    hashes = words.hashes()
    order = np.lexsort((hashes, words.text))
    text, term = words.text[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])])[:len(text)])
    return text[first], term[first], np.diff(np.append(first, len(text))), words.counts


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, terms, tfs of every row that has terms."""
    for part, texts in pieces(batches):
        text, term, tf, n = _counted(texts)
        cuts = np.searchsorted(text, np.arange(texts.n + 1))
        out = pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n), blobs(term, cuts), blobs(tf.astype(np.uint32), cuts)], ["id", "n", "terms", "tfs"])
        yield out.filter(pa.array(n > 0))


@dataclass
class Block:
    """Postings of some documents of one stratum."""

    m: int
    terms: np.ndarray  # Sorted hashes.
    term_runs: np.ndarray  # Where the runs of each term end.
    run_tf: np.ndarray  # The tf of each run, falling within a term.
    run_end: np.ndarray  # Where the postings of each run end.
    places: np.ndarray  # Documents of the block.

    @classmethod
    def build(cls, m: int, terms: list[bytes], tfs: list[bytes]) -> Block:
        size = [len(x) // 8 for x in terms]
        term, tf = np.frombuffer(b"".join(terms), np.uint64), np.frombuffer(b"".join(tfs), np.uint32)
        place = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((place, -tf.astype(np.int64), term))
        term, tf, place = term[order], tf[order], place[order]
        new_term = np.concatenate([[True], term[1:] != term[:-1]])
        first = np.flatnonzero(new_term | np.concatenate([[True], tf[1:] != tf[:-1]]))
        first_run = np.flatnonzero(new_term[first])
        return cls(m, term[first[first_run]], np.append(first_run[1:], len(first)).astype(np.uint32), tf[first],
                   np.append(first[1:], len(term)).astype(np.uint32), place.astype(np.uint16))

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(row["m"], np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["term_runs"], np.uint32),
                   np.frombuffer(row["run_tf"], np.uint32), np.frombuffer(row["run_end"], np.uint32),
                   np.frombuffer(row.get("places", b""), np.uint16))

    def known(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted `wanted` terms the block has, and their places in it."""
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == wanted)
        return has, at[has]

    def first_runs(self, at: np.ndarray) -> np.ndarray:
        return np.where(at > 0, self.term_runs[at - 1], 0).astype(np.int64)

    def documents_with(self, at: np.ndarray) -> np.ndarray:
        first = self.first_runs(at)
        start = np.where(first > 0, self.run_end[first - 1], 0).astype(np.int64)
        return self.run_end[self.term_runs[at].astype(np.int64) - 1].astype(np.int64) - start

    def impact(self, tf: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.m)

    def bounds(self, at: np.ndarray) -> np.ndarray:
        """The largest impact of terms in the block."""
        return self.impact(self.run_tf[self.first_runs(at)])

    def impacts(self, at: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, impact of every term in each of the next SCORED documents)."""
        first, last = self.first_runs(at), self.term_runs[at].astype(np.int64)
        runs = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(first, last, strict=True))])
        of_term = np.repeat(np.arange(len(at)), last - first)
        start = np.where(runs > 0, self.run_end[runs - 1], 0).astype(np.int64)
        size = self.run_end[runs].astype(np.int64) - start
        # Every run's impact once, handed to its postings.
        value = np.repeat(self.impact(self.run_tf[runs]), size)
        term = np.repeat(of_term, size)
        posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        place = self.places[posting].astype(np.int64)
        for low in range(0, docs, SCORED):
            inside = (place >= low) & (place < low + SCORED)
            table = np.zeros((len(at), min(SCORED, docs - low)))
            table[term[inside], place[inside] - low] = value[inside]
            yield low, table


BLOCK = "terms binary, term_runs binary, run_tf binary, run_end binary, places binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that are sorted by m."""

    def block(m: int, ids: list, terms: list[bytes], tfs: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        made = Block.build(m, terms, tfs)
        return pa.RecordBatch.from_arrays([
            pa.array([m], pa.int64()), pa.array([ids], pa.list_(kind)),
            *(pa.array([x.tobytes()], pa.binary()) for x in (made.terms, made.term_runs, made.run_tf, made.run_end, made.places))],
            ["m", "ids", "terms", "term_runs", "run_tf", "run_end", "places"])

    m, held, words, kind = None, ([], [], []), 0, pa.int64()
    for batch in batches:
        kind = batch.column(1).type
        for stratum, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held[0] and (stratum != m or len(held[0]) == BLOCK_DOCS or words >= BLOCK_WORDS):
                yield block(m, *held, kind)
                held, words = ([], [], []), 0
            m = stratum
            for column, value in zip(held, row, strict=True):
                column.append(value)
            words += len(row[1]) // 8
    if held[0]:
        yield block(m, *held, kind)


@dataclass
class Index:
    blocks: DataFrame  # block, m, ids, terms, term_runs, run_tf, run_end, places
    documents: int  # N


def build_index(docs: DataFrame, id_column: str = "doc_id") -> Index:
    """The index of all rows of `docs`, as stored tables."""
    room = Scratch(docs.sparkSession, "strata")
    kind = dict(docs.dtypes)[id_column]
    forward = room.store(docs.select(F.col(id_column).alias("id"), "text").mapInArrow(
        _forward, f"id {kind}, n long, terms binary, tfs binary").withColumn("row", F.monotonically_increasing_id()))
    documents, words = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    m = F.expr(f"10 + (90 * n * {documents}L) div {max(1, words)}L").alias("m")
    placed = forward.select(m, "id", "terms", "tfs", "row").repartitionByRange("m", "row").sortWithinPartitions("m").drop("row")
    blocks = placed.mapInArrow(_blocks, f"m long, ids array<{kind}>, {BLOCK}").withColumn("block", F.monotonically_increasing_id())
    with rows_at_a_time(docs.sparkSession, READ_ROWS):
        index = Index(room.store(blocks, **{"parquet.block.size": ROW_GROUP}), documents)
    room.drop(forward)
    return index


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches):
        text, term, _, _ = _counted(texts)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(term.view(np.int64))], ["item_id", "term"])


@dataclass
class Queries:
    """A group of queries as a sparse matrix of weights: `weight` of `term` in `item`."""

    terms: np.ndarray  # Sorted hashes.
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    limit: np.ndarray  # What a score must reach to count, by item.

    @property
    def items(self) -> int:
        return int(self.item.max()) + 1

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.items, len(self.terms)))
        out[self.item, self.term] = self.weight
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after the other, each in Python by itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def document_counts(index: Index, terms: np.ndarray) -> np.ndarray:
    """df of the sorted `terms`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for row in _rows(batches):
            block = Block.read(row)
            has, at = block.known(terms)
            total[has] += block.documents_with(at)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "df"])

    found = index.blocks.select("m", "terms", "term_runs", "run_tf", "run_end").mapInArrow(work, "term long, df long")
    out = np.zeros(len(terms), dtype=np.int64)
    for row in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def seed_blocks(index: Index, queries: Queries) -> list[int]:
    """The numbers of the blocks with the highest bounds of each query."""
    matrix = queries.matrix()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block.read(row)
            has, at = block.known(queries.terms)
            bound = matrix[:, has] @ block.bounds(at)
            items = np.flatnonzero(bound)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items), pa.array(bound[items]), pa.array(np.full(len(items), row["block"]))], ["item", "bound", "block"])

    found = index.blocks.select("block", "m", "terms", "term_runs", "run_tf", "run_end").mapInArrow(work, "item long, bound double, block long")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    best = found.withColumn("rank", F.row_number().over(by_bound)).filter(f"rank <= {SEEDS}")
    return [r["block"] for r in best.select("block").distinct().collect()]


class _Best:
    """The best documents of each query that a task has found."""

    def __init__(self, limit: np.ndarray):
        self.limit, self.rows, self.n = limit.astype(np.float64), [], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: list) -> None:
        if len(item):
            self.rows.append((item, score, ids))
            self.n += len(item)
            if self.n >= HELD:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, list]:
        item = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in self.rows)])
        score = np.concatenate([np.zeros(0), *(r[1] for r in self.rows)])
        ids = [x for r in self.rows for x in r[2]]
        by_id = np.argsort(np.array([i for i, _ in sorted(enumerate(ids), key=lambda x: (x[1] is None, x[1]))], dtype=np.int64))
        order = np.lexsort((by_id, -score, item))
        sorted_item = item[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        order, rank = order[rank < TOP], rank[rank < TOP]
        tenth = order[rank == TOP - 1]
        self.limit[item[tenth]] = np.maximum(self.limit[item[tenth]], score[tenth])
        kept = item[order], score[order], [ids[i] for i in order.tolist()]
        self.rows, self.n = [kept], 0
        return kept


def _visit(blocks: DataFrame, queries: Queries, kind: str) -> DataFrame:
    """item, score, id: the best documents of each task, at least those of the best ten that are in `blocks`."""
    matrix = queries.matrix()

    def score(block: Block, ids: list, best: _Best) -> None:
        has, at = block.known(queries.terms)
        bound = matrix[:, has] @ block.bounds(at)
        items = np.flatnonzero((bound >= best.limit) & (bound > 0))
        if not len(items):
            return
        weights = matrix[np.ix_(items, has)]
        used = np.flatnonzero(weights.any(axis=0))
        for low, table in block.impacts(at[used], len(ids)):
            scores = weights[:, used] @ table
            item, place = np.nonzero((scores >= best.limit[items][:, None]) & (scores > 0))
            best.add(items[item], scores[item, place], [ids[low + p] for p in place.tolist()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries.limit)
        for batch in batches:
            # Blocks with the highest bounds first.
            top = []
            for row in _rows(iter([batch.drop_columns(["ids", "places"])])):
                block = Block.read(row)
                has, at = block.known(queries.terms)
                top.append((matrix[:, has] @ block.bounds(at)).max(initial=0.0))
            for i in np.argsort(-np.array(top), kind="stable").tolist():
                if top[i] > 0:
                    row = batch.slice(i, 1).to_pylist()[0]
                    score(Block.read(row), row["ids"], best)
        item, value, ids = best.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(value.astype(np.int64)), pa.array(ids, id_type)], ["item", "score", "id"])

    columns = ["m", "ids", "terms", "term_runs", "run_tf", "run_end", "places"]
    id_type = blocks.select("ids").limit(0).toArrow().schema.field("ids").type.value_type
    return blocks.select(*columns).mapInArrow(work, f"item long, score long, id {kind}")


def _best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {TOP}")


def _groups(terms: DataFrame) -> Iterator[pa.Table]:
    """Queries in groups of about GROUP_TERMS rows of (item_id, term), all rows of a query in one."""
    n = max(1, -(-terms.count() // GROUP_TERMS))
    for i in range(n):
        group = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).toArrow()
        if group.num_rows:
            yield group


def search(index: Index, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of every row of `items` (item_id, text)."""
    spark: SparkSession = items.sparkSession
    room = Scratch(spark, "search")
    item_kind, doc_kind = dict(items.dtypes)["item_id"], dict(index.blocks.dtypes)["ids"][len("array<"):-1]
    terms = room.store(items.select("item_id", "text").mapInArrow(_terms, f"item_id {item_kind}, term long").distinct())
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for group in _groups(terms):
        with rows_at_a_time(spark, READ_BLOCKS):
            out = out.unionAll(room.store(_search_group(index, group, item_kind, doc_kind)))
    return out


def _search_group(index: Index, group: pa.Table, item_kind: str, doc_kind: str) -> DataFrame:
    spark, names = index.blocks.sparkSession, group["item_id"].unique()
    hashes, term = np.unique(group["term"].to_numpy().view(np.uint64), return_inverse=True)
    df = document_counts(index, hashes)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
    queries = Queries(hashes, _numbers(group["item_id"], names), term, weight[term], np.zeros(len(names)))
    seeds = index.blocks.filter(F.col("block").isin(seed_blocks(index, queries)))
    for row in _best(_visit(seeds, queries, doc_kind)).filter(f"rank = {TOP}").collect():
        queries.limit[row["item"]] = row["score"]
    best = _best(_visit(index.blocks, queries, doc_kind))
    numbered = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int64()), "item_id": names}))
    return best.join(F.broadcast(numbered), "item").select(
        F.col("item_id").cast(item_kind).alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _numbers(column: pa.ChunkedArray, names: pa.Array) -> np.ndarray:
    place = {name: i for i, name in enumerate(names.to_pylist())}
    return np.array([place[x] for x in column.to_pylist()], dtype=np.int64)


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`search` in an index of `docs`."""
    return search(build_index(docs), items)
