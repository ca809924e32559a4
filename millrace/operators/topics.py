"""EM-LDA (Asuncion et al. 2009, as Spark's own learner has it) over blocks of documents.

What a topic takes of a document stays with the document's block, so a round moves no (document, term) pair: a task goes over
its blocks and sends back one matrix of the vocabulary's size, and the sum of these is sent to all tasks for the next round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir, spread, store

#: Pairs of document and term in a block, so that what a round makes of them stays in a core's cache; a longer document is a
#: block of its own.
BLOCK_PAIRS = 50_000
#: Rounds in which the mixture of a document is sought for given topics, and the change at which that ends.
MIX_ROUNDS, MIX_CHANGE = 100, 1e-4


class Block(NamedTuple):
    """Documents as counts of terms: how many terms each has, the terms below each other, and how often each occurs."""
    sizes: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


class TopicModel(NamedTuple):
    """How often each term (row) is taken for each topic (column), and the likelihood of the tokens learned from."""
    weights: np.ndarray
    alpha: float
    eta: float
    log_likelihood: float

    def trainingLogLikelihood(self) -> float:  # noqa: N802 - as Spark's model has it
        return self.log_likelihood

    def vocabSize(self) -> int:  # noqa: N802
        return len(self.weights)


def _by_term(terms: np.ndarray, taken: np.ndarray, size: int) -> np.ndarray:
    """What each topic (row) takes of each term."""
    return np.stack([np.bincount(terms, weights=row, minlength=size) for row in taken])


def _by_document(block: Block, taken: np.ndarray) -> np.ndarray:
    """What each topic (row) takes of each document; its pairs lie side by side."""
    sums = np.zeros((len(taken), len(block.sizes)))
    filled = block.sizes > 0
    if filled.any():
        sums[:, filled] = np.add.reduceat(taken, (np.cumsum(block.sizes) - block.sizes)[filled], axis=1)
    return sums


def _shares(weights: np.ndarray, eta: float) -> np.ndarray:
    return (weights + (eta - 1)) / (weights.sum(axis=1, keepdims=True) + weights.shape[1] * (eta - 1))


def _chances(block: Block, shares: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Of each pair (column) the share of its term in a topic (row) times its document's part of the topic."""
    chances = shares.take(block.terms, axis=1)
    chances *= np.repeat(mixed, block.sizes, axis=1)
    return chances


def _taken(block: Block, shares: np.ndarray, mixed: np.ndarray, alpha: float) -> np.ndarray:
    """How often each topic (row) takes each pair (column)."""
    taken = _chances(block, shares, mixed + (alpha - 1))
    taken *= block.counts / taken.sum(axis=0)
    return taken


def _log_likelihood(block: Block, shares: np.ndarray, mixed: np.ndarray, alpha: float) -> float:
    smooth = mixed + (alpha - 1)
    chance = _chances(block, shares, smooth / smooth.sum(axis=0)).sum(axis=0)
    known = chance > 0
    return float((block.counts[known] * np.log(chance[known])).sum())


def _read(batch: pa.RecordBatch) -> Iterator[Block]:
    """The documents of a batch in blocks."""
    terms, counts = batch.column(0), batch.column(1)
    sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.intp)
    counts = counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        start = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, start + BLOCK_PAIRS, side="right")))
        yield Block(sizes[at:to], terms[start:ends[to - 1]], counts[start:ends[to - 1]])
        at = to


def _pairs(vectors: DataFrame) -> DataFrame:
    """The terms and counts of sparse vectors (`features`)."""
    features = F.unwrap_udt("features")
    return vectors.select(features["indices"].alias("terms"), features["values"].alias("counts"))


def fit(vectors: DataFrame, k: int, iterations: int, checkpoint_interval: int = -1, seed: int = 42,
        vocab_size: int | None = None) -> TopicModel:
    """Topics of sparse count vectors; with an interval, checkpoints after that many rounds.

    Priors are those that Spark takes for this learner. Each block starts with random topics, by its content and the seed.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    shared_dir(spark)
    alpha, eta = 50 / k + 1, 1.1
    if vocab_size is None:
        vocab_size = vectors.select(F.max(F.unwrap_udt("features")["size"])).head()[0] or 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _read(batch):
                yield pa.RecordBatch.from_pydict({
                    "sizes": [block.sizes.tobytes()], "terms": [block.terms.astype(np.int32).tobytes()], "counts": [block.counts.astype(np.float32).tobytes()]})

    # float32 holds counts up to 16 million exactly; a term that occurs more often in a document is off by a ten-millionth.
    stored = store(_pairs(vectors).mapInArrow(packed, "sizes binary, terms binary, counts binary"), "blocks")

    def block_of(element: tuple) -> Block:
        return Block(
            np.frombuffer(element[0], np.int64), np.frombuffer(element[1], np.int32).astype(np.intp),
            np.frombuffer(element[2], np.float32).astype(np.float64))

    def mixed_of(element: tuple) -> np.ndarray:
        return np.frombuffer(element[3]).reshape(k, -1)

    def start(rows: Iterator) -> Iterator[tuple]:
        total = np.zeros((k, vocab_size))
        for row in rows:
            parts = tuple(bytes(x) for x in row)
            block = block_of(parts)
            drawn = np.random.default_rng([seed, zlib.crc32(parts[1]), zlib.crc32(parts[2])]).random((len(block.terms), k))
            taken = np.ascontiguousarray((drawn * (block.counts / drawn.sum(axis=1))[:, None]).T)
            total += _by_term(block.terms, taken, vocab_size)
            yield (*parts, _by_document(block, taken).tobytes())
        yield (total,)

    def advanced(shares: np.ndarray):
        sent = context.broadcast(shares)

        def step(elements: Iterator[tuple]) -> Iterator[tuple]:
            total = np.zeros((k, vocab_size))
            for element in elements:
                if len(element) == 1:
                    continue
                block = block_of(element)
                taken = _taken(block, sent.value, mixed_of(element), alpha)
                total += _by_term(block.terms, taken, vocab_size)
                yield (*element[:3], _by_document(block, taken).tobytes())
            yield (total,)

        return step, sent

    def total_of(state: RDD) -> np.ndarray:
        return state.filter(lambda e: len(e) == 1).map(lambda e: e[0]).treeReduce(np.add)

    rows = spread(stored).rdd
    if not rows.getNumPartitions() or not vocab_size:
        return TopicModel(np.zeros((vocab_size, k)), alpha, eta, 0.0)
    state = rows.mapPartitions(start).persist(StorageLevel.MEMORY_AND_DISK)
    weights = total_of(state)
    for number in range(1, iterations + 1):
        step, sent = advanced(_shares(weights, eta))
        after = state.mapPartitions(step).persist(StorageLevel.MEMORY_AND_DISK)
        if checkpoint_interval > 0 and number % checkpoint_interval == 0:
            after.checkpoint()
        weights = total_of(after)
        state.unpersist()
        state = after
    shares = _shares(weights, eta)
    likelihood = state.filter(lambda e: len(e) > 1).map(
        lambda e: _log_likelihood(block_of(e), shares, mixed_of(e), alpha)).sum()
    state.unpersist()
    return TopicModel(np.ascontiguousarray(weights.T), alpha, eta, float(likelihood))


def likelihoods(model: TopicModel, vectors: DataFrame) -> DataFrame:
    """n_tokens, log_likelihood of blocks of `vectors`, each document with the mixture of topics that the model infers for it."""
    weights, alpha = np.ascontiguousarray(model.weights.T), model.alpha
    total = weights.sum(axis=1, keepdims=True)
    shares = weights / np.where(total > 0, total, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _read(batch):
                tokens = _by_document(block, block.counts[None])[0]
                mixed = np.repeat(tokens[None] / len(weights), len(weights), axis=0)
                for _ in range(MIX_ROUNDS):
                    better = _by_document(block, _taken(block, shares, mixed, alpha))
                    change = np.abs(better - mixed).max(initial=0)
                    mixed = better
                    if change < MIX_CHANGE:
                        break
                yield pa.RecordBatch.from_pydict({
                    "n_tokens": [int(tokens.sum())], "log_likelihood": [_log_likelihood(block, shares, mixed, alpha)]})

    return _pairs(vectors).mapInArrow(work, "n_tokens long, log_likelihood double")
