"""Toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Features are the n-grams of 4 to 10 bytes of the text with A-Z lowered, hashed to bins; a text has a bin or not. A bin's
ratio compares in how many toxic and other texts it occurs, smoothed. The bins whose ratio is surest are kept, scaled by
their ratio, and weighed by logistic regression. Scoring adds the weights of the bins a text has.

The model is fitted on at most MAX_TRAIN labelled texts (those whose ids have the smallest hashes), which bounds what
the driver holds; ratios and features of those texts are counted in tasks. Every text is scored whole.

Null and empty texts have no bins: their score is the share the intercept gives. Labels that are null are left out; a
doc_id with several labels is toxic if one says so. Without labels of both kinds every score is the smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.words import BYTE_VALUES, LOWER, Texts, mix, pieces

GRAMS, BIN_BITS = (4, 5, 6, 7, 8, 10), 20
#: Labelled texts the model is fitted on, and bins it weighs.
MAX_TRAIN, MAX_FEATURES = 20_000, 8_192
FOLDS, STEPS, PENALTY = 5, 300, 1e-4
SLICES = 32


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id's text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _grams(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin, first byte) of all n-grams within a text, one size after another."""
    data = BYTE_VALUES[LOWER[texts.data]]
    value = data.copy()
    for size in range(2, max(GRAMS) + 1):
        n = len(data) - size + 1
        if n <= 0:
            return
        value = value[:n] * np.uint64(0x100000001B3) + data[size - 1:]
        if size in GRAMS:
            inside = np.ones(n, dtype=bool)
            for i in range(1, size):
                cut = texts.bounds[1:-1] - i
                inside[cut[(cut >= 0) & (cut < n)]] = False
            bins = (mix(value + np.uint64(size)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
            yield bins[inside], np.flatnonzero(inside)


def _present(texts: Texts, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of the bins marked in `wanted` that each text has, each once."""
    found = [np.zeros(0, dtype=np.int64)]
    for bins, at in _grams(texts):
        kept = wanted[bins]
        owner = np.searchsorted(texts.bounds, at[kept], side="right") - 1
        found.append(owner << BIN_BITS | bins[kept])
    both = np.unique(np.concatenate(found))
    return both >> BIN_BITS, both & ((1 << BIN_BITS) - 1)


def _counts(texts: Texts, toxic: np.ndarray, counts: np.ndarray) -> None:
    """Add to `counts` (a row for clean texts, one for toxic ones) the bins that each text has."""
    sized = [(bins.astype(np.int32), np.searchsorted(at, texts.bounds)) for bins, at in _grams(texts)]
    seen = np.zeros(1 << BIN_BITS, dtype=bool)
    for i in range(texts.n):
        for bins, cuts in sized:
            seen[bins[cuts[i]:cuts[i + 1]]] = True
        has = np.flatnonzero(seen)
        counts[int(toxic[i]), has] += 1
        seen[has] = False


@dataclass
class Model:
    weights: np.ndarray  # By bin; zero for bins that are not weighed.
    intercept: float

    def scores(self, texts: Texts) -> np.ndarray:
        text, bins = _present(texts, self.weights != 0)
        total = np.bincount(text, weights=self.weights[bins], minlength=texts.n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of at most `limit` labelled documents outside the held-out fold."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(limit)
    # Bounded by `limit` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _logistic(text: np.ndarray, column: np.ndarray, value: np.ndarray, toxic: np.ndarray, columns: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse rows, by accelerated gradients."""
    n = len(toxic)
    share = (toxic.sum() + 0.5) / (n + 1)
    weights, intercept = np.zeros(columns), float(np.log(share / (1 - share)))
    # A bound of the curvature: a quarter of the largest squared row norm.
    norm = np.bincount(text, weights=value * value, minlength=n).max(initial=0.0) + 1
    step = 4 / norm
    ahead, ahead_0, momentum = weights, intercept, 1.0
    for _ in range(STEPS):
        total = np.bincount(text, weights=ahead[column] * value, minlength=n) + ahead_0
        miss = 1 / (1 + np.exp(-np.clip(total, -700, 700))) - toxic
        slope = np.bincount(column, weights=miss[text] * value, minlength=columns)
        moved = (ahead - step * (slope + PENALTY * n * ahead)) if n else ahead
        moved_0 = ahead_0 - step * miss.sum()
        further = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, ahead_0 = (new + (momentum - 1) / further * (new - old) for new, old in ((moved, weights), (moved_0, intercept)))
        weights, intercept, momentum = moved, moved_0, further
    return weights, intercept


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    rows = Scratch(docs.sparkSession, "toxic-train").store(training_rows(docs, labels, limit))
    sizes = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1)
    if not toxic or not clean:
        return Model(np.zeros(1 << BIN_BITS), float(np.log((toxic + 0.5) / (clean + 0.5))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BIN_BITS), dtype=np.int32)
        for part, texts in pieces(batches):
            _counts(texts, part.column("toxic").to_numpy(zero_copy_only=False) == 1, both)
        if both.any():
            parts = both.reshape(2, SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([parts[:, i].tobytes() for i in range(SLICES)])], ["slice", "counts"])

    # The sample is bounded, and so are the rows of a slice; all slices together are two counts for each bin.
    table = rows.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    total = np.stack([np.frombuffer(x, np.int32).reshape(2, -1) for x in table.orderBy("slice").toArrow()["counts"].to_pylist()])
    both = total.transpose(1, 0, 2).reshape(2, -1)
    bins = np.flatnonzero(both.any(axis=0))
    with_clean, with_toxic = both[0, bins].astype(float), both[1, bins].astype(float)
    ratio = np.log((with_toxic + 0.5) / (toxic + 1)) - np.log((with_clean + 0.5) / (clean + 1))
    sureness = np.abs(ratio) / np.sqrt(1 / (with_toxic + 0.5) + 1 / (with_clean + 0.5))
    best = np.lexsort((bins, -sureness))[:MAX_FEATURES]
    scale = np.zeros(1 << BIN_BITS)
    scale[bins[best]] = ratio[best]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            text, found = _present(texts, scale != 0)
            cuts = np.searchsorted(text, np.arange(texts.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))], ["toxic", "bins"])

    # At most `limit` rows of at most MAX_FEATURES bins.
    sample = rows.mapInArrow(features, f"toxic {dict(rows.dtypes)['toxic']}, bins array<int>").toArrow().combine_chunks()
    lists = sample["bins"].chunk(0) if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    column = lists.flatten().to_numpy()
    text = np.repeat(np.arange(sample.num_rows), lists.value_lengths().to_numpy())
    label = (sample["toxic"].to_numpy() == 1).astype(float)
    weights, intercept = _logistic(text, column, scale[column], label, 1 << BIN_BITS)
    return Model(weights * scale, intercept)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int32) for x in table["counts"])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype(np.int32).tobytes()])})


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, limit)
    used = np.flatnonzero(model.weights)
    sent, intercept = (used, model.weights[used]), model.intercept

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BIN_BITS)
        weights[sent[0]] = sent[1]
        for part, texts in pieces(batches):
            found = Model(weights, intercept).scores(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
    return scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)))
