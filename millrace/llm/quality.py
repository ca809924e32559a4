"""Quality rules: base counts of a text, and a hashed n-gram likelihood ratio of trusted text to the whole corpus.

The n-grams are those of four bytes, hashed to 65,536 bins. Both sides are multinomials over the bins: the raw one
counts every text; the trusted one counts texts labelled as good, and is drawn to the raw one by a prior of one count
per bin. A text's score is the mean log ratio of its n-grams (natural logarithm), so long and short texts compare. It
is kept if the score reaches a fixed threshold: the same text and model give the same verdict in every run.

Null and empty texts have no words and n-grams: counts and score 0. Repeated rows are judged each by itself, from
counts that include them all. Without labels every score is 0. Only `doc_id`, `text` and the label columns are read;
other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import NEWLINE, SPACE, Texts, mix, pieces, sum_by

GRAM, BIN_BITS = 4, 16
BINS = 1 << BIN_BITS
THRESHOLD = -0.3
#: Trusted texts the target is fitted on: those whose ids have the smallest hashes. Bounds the list sent to tasks.
MAX_TRUSTED = 20_000

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base columns of a piece, see `BASE`."""
    words = texts.spans(SPACE)
    salt = mix(np.arange(texts.n, dtype=np.uint64))
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.data])])[texts.bounds]

    lines = texts.spans(NEWLINE, keep_empty=True)
    worded = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
    _, before = _repeated(mix(lines.hashes()[worded] ^ salt[lines.text[worded]]) + (lines.ends - lines.starts)[worded].astype(np.uint64))

    at, window = words.windows(words.hashes(), REPEAT_WINDOW)
    again, _ = _repeated(mix(window ^ salt[words.text[at]]))
    step = np.zeros(len(words.starts) + 1, dtype=np.int64)
    step[at[again]] += 1
    step[at[again] + REPEAT_WINDOW] -= 1
    repeated = sum_by(words.text, np.cumsum(step)[:-1] > 0, texts.n)
    return {
        "n_words": words.counts,
        "word_chars": sum_by(words.text, points[words.ends] - points[words.starts], texts.n),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": sum_by(lines.text[worded], before, texts.n),
        "n_repeat_words": repeated,
        "base_failed": (words.counts < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words.counts),
    }


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bin of the n-gram at every byte, and whether that n-gram lies within one text."""
    n = max(0, len(texts.data) - GRAM + 1)
    value = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        value |= texts.data[i:i + n].astype(np.uint32) << np.uint32(8 * i)
    bins = (value * np.uint32(2654435761)) >> np.uint32(32 - BIN_BITS)
    inside = np.ones(n, dtype=bool)
    for i in range(1, GRAM):
        cut = texts.bounds[1:-1] - i
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return bins, inside


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> np.ndarray:
    """Ids labelled as of good quality: the `limit` ones with the smallest hashes, at most."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    picked = ids.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(limit).toArrow()
    return np.sort(picked["doc_id"].to_numpy())


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of every bin, from all documents and the trusted ones."""
    trusted = pa.array(trusted_ids(labels), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for part, texts in pieces(batches):
            bins, inside = grams(texts)
            raw += np.bincount(bins[inside], minlength=BINS)
            chosen = pc.is_in(part.column("doc_id").cast(pa.int64()), value_set=trusted).to_numpy(zero_copy_only=False)
            if chosen.any():
                inside &= np.repeat(chosen, np.diff(texts.bounds))[:len(inside)]
                good += np.bincount(bins[inside], minlength=BINS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (seen.astype(np.int32), raw[seen], good[seen])], ["bin", "raw", "good"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bin int, raw long, good long")
    table = counts.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BINS), np.zeros(BINS)
    raw[table["bin"].to_numpy()], good[table["bin"].to_numpy()] = table["raw"].to_numpy(), table["good"].to_numpy()
    if not good.sum():
        return np.zeros(BINS, np.float32)
    everywhere = (raw + 1) / (raw.sum() + BINS)
    wanted = (good + BINS * everywhere) / (good.sum() + BINS)
    return np.log(wanted / everywhere).astype(np.float32)


def mean_ratio(texts: Texts, ratios: np.ndarray) -> np.ndarray:
    bins, inside = grams(texts)
    total = np.zeros(len(texts.data) + 1)
    np.cumsum(np.where(inside, ratios[bins], 0.0), out=total[1:len(bins) + 1])
    total[len(bins) + 1:] = total[len(bins)]
    length = np.diff(texts.bounds)
    return (total[texts.bounds[1:]] - total[texts.bounds[:-1]]) / np.maximum(length - GRAM + 1, 1) * (length >= GRAM)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, `score`, and `kept`: neither failed by the base nor scored below `threshold`."""
    ratios = log_ratios(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            base, mean = base_counts(texts), mean_ratio(texts, ratios)
            columns = {**base, "score": mean, "kept": ~base["base_failed"] & (mean >= threshold)}
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x) for x in columns.values())], ["doc_id", *columns])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {BASE}, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps. No row is shuffled."""
    ratios = log_ratios(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            kept = ~base_counts(texts)["base_failed"] & (mean_ratio(texts, ratios) >= threshold)
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
