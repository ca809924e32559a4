"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words with A-Z lowered and an end after each text. The most frequent ones are units of their own; all others
share units by hash. Units are the leaves of a tree of classes: WIDTH classes, WIDTH in each, and so on. P(token | context) is
the product over the levels of P(class | class above, context), times P(token in unit). Each of the former is a softmax over WIDTH
children; what is summed up is the children's share of their class's count and the weights of the active features: the last
unit, at the first levels also both last ones together, and at the root the one before the last (a skip), each with the class.
Their hash names a row of WIDTH weights.
P(token in unit) is the token's smoothed share of its unit's count. So the scores are those of one model, a distribution over all
tokens after any context, for training texts and others alike.

Sizes follow the lexicon: levels until there is a unit for every fourth distinct token (WIDTH ** MAX_LEVELS units at most), and
rows of weights by its cube root (2 ** MAX_ROW_BITS at most), as all of them are sent to every task. Training goes over every training
document once, in rounds whose number grows with the logarithm of the tokens. In a round each partition takes gradient steps over
its tokens from the weights sent to it; of each row, the changes of all partitions are brought `together` by the tokens that
used the row there, so what one partition alone has seen is kept in full. Scoring runs the model over batches of tokens.

`base_score` is the smoothed unigram sum of log10((c + 1) / (N + V + 1)). Null and empty texts are an end alone. Repeated rows
are documents of their own. Without training documents the units are equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import lexicon
from millrace.llm.components import Scratch
from millrace.llm.groups import repeated
from millrace.llm.toxicity import fold
from millrace.llm.words import Texts, mix, pieces

FOLDS, HELD_OUT = 7, 2
#: Children of a class (a power of two), levels of classes, and units that rare tokens share.
WIDTH, MAX_LEVELS, RARE = 16, 4, 64
#: Rows of weights, tokens of a gradient step, step size, and tokens of a corpus that is trained on in two rounds.
MIN_ROW_BITS, MAX_ROW_BITS, BATCH, RATE, SMALL = 15, 20, 1 << 13, 0.4, 1 << 20
#: Kinds of features (the last unit, the last two, a skip) that count at each level; the first alone further down.
KINDS = (3, 2, 1, 1)
#: What a row counts as spent before its first step: the more, the less a single token teaches.
FIRST = 1.0
#: Tokens of a row in a partition that are few, slices of rows, and partitions that one task adds up.
FEW, SLICES, LANE = 32, 32, 256
#: Tokens are found by the first 64 - SLOT bits of their hash.
SLOT = np.uint64(44)

_SALTS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xAF251AF3B0F025B5))
_CLASS = np.uint64(0x9E3779B97F4A7C15)


def levels_for(words: int) -> int:
    """Levels of classes for a lexicon of that many tokens."""
    return min(MAX_LEVELS, max(2, math.ceil(math.log(max(1, words / 4), WIDTH))))


def rows_for(words: int) -> int:
    """Rows of weights: eight times as many for 512 times as many tokens."""
    return 1 << min(MAX_ROW_BITS, max(MIN_ROW_BITS, 10 + math.floor(math.log2(max(1, words)) / 3)))


def rounds_for(tokens: int) -> int:
    """Four, and one more for every 16 times as many tokens."""
    return 4 + max(0, math.floor(math.log(max(1, tokens / SMALL), 16)))


@dataclass
class Units:
    """Tokens that are units of their own, by rank, and the counts of all units."""

    tokens: np.ndarray  # Sorted hashes.
    rank: np.ndarray  # The unit of each.
    total: np.ndarray  # Training count of each unit.
    rare_words: np.ndarray  # Distinct training tokens of each shared unit.

    @property
    def top(self) -> int:
        return len(self.total) - RARE

    @property
    def levels(self) -> int:
        return round(math.log(len(self.total), WIDTH))

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """By the first bits of a hash: a token with these (0 if none has), and whether others have them too."""
        slot = (self.tokens >> SLOT).astype(np.int64)
        place = np.zeros(1 << (64 - int(SLOT)), np.int32)
        place[slot] = np.arange(len(slot))
        return place, np.bincount(slot, minlength=len(place)) > 1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        unit = self.top + lexicon.rare_unit(hashes, RARE)
        if not len(self.tokens):
            return unit
        places, shared = self.slots
        slot = (hashes >> SLOT).astype(np.int64)
        place = places.take(slot)
        open_slot = np.flatnonzero(shared.take(slot))
        place[open_slot] = np.minimum(np.searchsorted(self.tokens, hashes[open_slot]), len(self.tokens) - 1)
        return np.where(self.tokens.take(place) == hashes, self.rank.take(place), unit)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "slots"}

    def log_share(self, unit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log P(token | unit) of tokens with these training counts."""
        shared = np.maximum(unit - self.top, 0)
        rare = np.log((count + 1) / (self.total[unit] + self.rare_words[shared] + 1))
        return np.where(unit < self.top, 0.0, rare)


def units(answered: DataFrame) -> tuple[Units, int, int]:
    """The units, the training tokens and the distinct ones among them."""
    held = answered.filter("held IS NOT NULL").select("held.*")
    sums = [F.sum(F.col(name)[i]).alias(f"{name}_{i}") for name in ("unit_total", "unit_words") for i in range(RARE)]
    row = held.agg(F.sum("total").alias("total"), F.sum("words").alias("words"), *sums).head()
    size = WIDTH ** levels_for(row["words"] or 0)
    top = size - RARE
    best = held.select(F.explode("best").alias("b")).select("b.*").orderBy(F.desc("n"), "token").limit(top).toArrow()
    token, n = best["token"].to_numpy().view(np.uint64), best["n"].to_numpy()
    total = np.zeros(size, dtype=np.int64)
    total[:len(n)] = n
    total[top:] = [row[f"unit_total_{i}"] or 0 for i in range(RARE)]
    words = np.array([row[f"unit_words_{i}"] or 0 for i in range(RARE)], dtype=np.int64)
    own = lexicon.rare_unit(token, RARE)
    total[top:] -= np.bincount(own, weights=n, minlength=RARE).astype(np.int64)
    words -= np.bincount(own, minlength=RARE)
    order = np.argsort(token)
    return Units(token[order], order.astype(np.int64), total, words), row["total"] or 0, row["words"] or 0


def first_class(level: int) -> int:
    """The number of the first class of a level; the root is 0."""
    return (WIDTH ** level - 1) // (WIDTH - 1)


def highest(logits: np.ndarray) -> np.ndarray:
    """The maximum of every row; along rows this short numpy would take several times as long."""
    return np.ascontiguousarray(logits.T).max(axis=0)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns of WIDTH values, halves added to halves as numpy does along a row, but for all columns at a time."""
    x = x[:WIDTH // 2] + x[WIDTH // 2:]
    while len(x) > 1:
        x = x[0::2] + x[1::2]
    return x[0]


def whole_rows(x: np.ndarray) -> np.ndarray:
    """A matrix as one value for each row, sharing its memory: numpy sets these in less than half the time."""
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


def added_up(slope: np.ndarray, of_kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the tokens of each, and the sum of their slopes. Most rows have one token, which is no sum."""
    order = np.argsort(of_kind)
    placed = of_kind.take(order)
    first = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    tokens = np.diff(np.append(first, len(order)))
    total = slope.take(order.take(first), axis=0)
    shared = tokens > 1
    if shared.any():
        several = tokens[shared]
        total[shared] = np.add.reduceat(slope.take(order[np.repeat(shared, tokens)], axis=0), np.cumsum(several) - several, axis=0)
    return placed.take(first), tokens, total


@dataclass
class Weights:
    shares: np.ndarray  # Log of the children's shares of their class, by class.
    rows: np.ndarray  # Weights of features.

    @classmethod
    def start(cls, found: Units, rows: int) -> Weights:
        """A model that knows the units' counts alone. Digit i of a unit, in base WIDTH, is its child at level i."""
        unit = np.arange(len(found.total))
        shares = []
        for level in range(found.levels):
            count = np.bincount(unit % WIDTH ** (level + 1), weights=found.total + 0.5).reshape(WIDTH, -1).T
            shares.append(np.log(count / count.sum(axis=1, keepdims=True)))
        return cls(np.concatenate(shares).astype(np.float32), np.zeros((rows, WIDTH), np.float32))

    @property
    def levels(self) -> int:
        return round(math.log(len(self.shares) * (WIDTH - 1) + 1, WIDTH))

    def steps(self, features: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For every level: the rows of each token's features, its child, all children's logits (a column for each token), and
        the log of the sum of their exponentials, which is still to be taken off.
        """
        for level in range(self.levels):
            above = WIDTH ** level
            klass = first_class(level) + (unit & (above - 1))
            rows = mix(features[:KINDS[level]] + klass.astype(np.uint64) * _CLASS)
            rows = (rows & np.uint64(len(self.rows) - 1)).astype(np.int64)  # Rows are a power of two.
            total = self.shares.take(klass, axis=0)
            for of_kind in rows:
                total += self.rows.take(of_kind, axis=0)
            total = np.ascontiguousarray(total.T)
            total -= highest(total.T)
            yield rows, unit >> level * (WIDTH.bit_length() - 1) & (WIDTH - 1), total, np.log(column_sums(np.exp(total)))

    def log_probability(self, features: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log P(unit | context) of tokens with these features."""
        out, at = np.zeros(len(unit)), np.arange(len(unit))
        for _, child, logits, total in self.steps(features, unit):
            out += logits[child, at] - total
        return out

    def train(self, spent: np.ndarray, used: np.ndarray, features: np.ndarray, unit: np.ndarray) -> None:
        """A gradient step of the log loss of a batch, in place; `used` counts the tokens of each row."""
        at, whole = np.arange(len(unit)), whole_rows(self.rows)
        for rows, child, logits, total in self.steps(features, unit):
            logits -= total
            slope = np.exp(logits, out=logits)
            slope[child, at] -= 1
            slope = np.ascontiguousarray(slope.T)
            for of_kind in rows:
                # Adagrad: the sum of a row's slopes, scaled by what the row has spent.
                row, tokens, total = added_up(slope, of_kind)
                now = spent.take(row) + np.einsum("ij,ij->i", total, total)
                spent[row] = now
                used[row] += tokens
                total *= (-RATE / np.sqrt(now + FIRST)).astype(np.float32)[:, None]
                total += self.rows.take(row, axis=0)
                whole[row] = whole_rows(total)


def contexts(text: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """Hashes of what is before every token, a row for each kind; a text starts after units that are none."""
    back = []
    for i in (1, 2):
        last = np.full(len(unit), units, dtype=np.uint64)
        last[i:] = np.where(text[i:] == text[:-i], unit[:-i], units)
        back.append(last)
    both = back[0] * np.uint64(units + 1) + back[1]
    return np.stack([mix(x + s) for x, s in zip((back[0], both, back[1]), _SALTS, strict=True)])


def _trainer(sent: Weights, found: Units):
    """Gradient steps over a partition; for each slice of rows the change of weights and the tokens that used them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(sent.shares, sent.rows.copy())
        spent, used = np.zeros(len(own.rows)), np.zeros(len(own.rows), np.float32)
        for _, texts in pieces(batches):
            text, hashes = lexicon.tokens(texts)
            unit = found.of(hashes)
            features = contexts(text, unit, len(found.total))
            for at in range(0, len(unit), BATCH):
                own.train(spent, used, features[:, at:at + BATCH], unit[at:at + BATCH])
        if used.any():
            change = own.rows - sent.rows
            scale = np.abs(change).max(axis=1) / 127
            steps = np.rint(change / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            columns = [np.split(x, SLICES) for x in (np.minimum(used, 60_000).astype(np.float16), scale.astype(np.float16), steps)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), *(pa.array([x.tobytes() for x in c]) for c in columns)], ["slice", "used", "scale", "steps"])

    return work


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Of a slice, for some partitions: tokens that used each row, their squares, and changes times tokens, added up."""
    used = squares = total = 0
    for row in table.select(["used", "scale", "steps"]).to_pylist():
        tokens, scale = (np.frombuffer(row[c], np.float16).astype(np.float32) for c in ("used", "scale"))
        steps = np.frombuffer(row["steps"], np.int8).reshape(len(tokens), WIDTH)
        used, squares, total = used + tokens, squares + tokens * tokens, total + steps * (scale * tokens)[:, None]
    return _sums(key, used, squares, total)


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    return _sums(key, *(sum(np.frombuffer(x, np.float32) for x in table[c].to_pylist()) for c in ("used", "squares", "total")))


def _sums(key: tuple, *sums: np.ndarray) -> pa.Table:
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), **{
        c: pa.array([x.astype(np.float32).tobytes()]) for c, x in zip(("used", "squares", "total"), sums, strict=True)}})


def together(used: np.ndarray, squares: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The change of every row from the sums of its changes times tokens, of its tokens, and of their squares by partition.

    Partitions that have used a row often have each found where its weights should be, and their mean is taken. Those that
    have used it a few times have only gone some way, and more of them go further: as the root of their number.
    """
    partitions = np.maximum(used * used / np.maximum(squares, 1e-9), 1)
    each = used / partitions
    return total / np.maximum(used, 1e-9)[:, None] * (partitions ** (0.5 / (1 + each / FEW)))[:, None]


def train(docs: DataFrame, found: Units, rows: int, rounds: int) -> Weights:
    """Weights trained on `docs` (doc_id, text), every document in one of the rounds."""
    weights, sums = Weights.start(found, rows), "slice int, used binary, squares binary, total binary"
    # So many partitions are added up by one task at first.
    lanes = max(1, docs.rdd.getNumPartitions() // LANE)
    for turn in range(rounds):
        some = docs.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(rounds)) == turn)
        changes = some.select("text").mapInArrow(_trainer(weights, found), "slice int, used binary, scale binary, steps binary")
        lane = changes.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        total = lane.groupBy("slice", "lane").applyInArrow(_added, sums).groupBy("slice").applyInArrow(_merged, sums).orderBy("slice").toArrow()
        if total.num_rows:
            used, squares, change = (np.frombuffer(b"".join(total[c].to_pylist()), np.float32) for c in ("used", "squares", "total"))
            weights.rows = weights.rows + together(used, squares, change.reshape(rows, WIDTH)).astype(np.float32)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    buckets = lexicon.BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    texts = lexicon.grouped(marked)
    answered = Scratch(spark, "lexicon").store(lexicon.answer(lexicon.ask(texts, buckets), WIDTH ** MAX_LEVELS, RARE))
    found, total, words = units(answered)
    weights = train(marked.filter("NOT held_out").select("doc_id", "text"), found, rows_for(words), rounds_for(total))

    def work(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        # The same tokens in the same order as when they were asked about.
        text, hashes = lexicon.tokens(Texts(batch.column("text")))
        count = lexicon.told(answers, hashes, buckets)
        n, unit = batch.num_rows, found.of(hashes)
        features = contexts(text, unit, len(found.total))
        logs = found.log_share(unit, count)
        for at in range(0, len(unit), BATCH):
            logs[at:at + BATCH] += weights.log_probability(features[:, at:at + BATCH], unit[at:at + BATCH])
        return pa.table({
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(np.bincount(text, minlength=n)),
            "n_known": pa.array(np.bincount(text, weights=count > 0, minlength=n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, dtype=np.int64)),
            "base_score": pa.array(np.bincount(text, weights=np.log10((count + 1) / (total + words + 1)), minlength=n)),
            "score": pa.array(np.bincount(text, weights=logs, minlength=n) / np.log(10)), "copies": batch.column("copies")})

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, copies long"
    told = answered.select("part", "bucket", "counts")
    return repeated(texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(work, schema), "copies")
