from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import lexicon, maxent
from millrace.llm.words import Texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for i, t in rows]
    count = Counter(w for i, row in tokens if not held_out(i) for w in row)
    total, words = sum(count.values()), len(count)
    return [(i, held_out(i), len(row), sum(count[w] > 0 for w in row), total,
             sum(math.log10((count[w] + 1) / (total + words + 1)) for w in row)) for i, row in tokens]


def test_base_equals_brute_force(awkward, awkward_rows):
    got = sorted((tuple(r)[:6] for r in maxent.score(awkward).collect()), key=str)
    want = sorted(brute(awkward_rows), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_the_model_learns_an_order_that_counts_do_not_show(spark):
    docs = spark.createDataFrame([(i, " ".join(["one two three four"] * 30)) for i in range(60)], "doc_id long, text string")
    rows = maxent.score(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["score"] > 0.5 * r["base_score"] for r in held)


def test_order_of_rare_words_is_learned(spark):
    # 1500 pairs of words that always come together.
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"left{j} right{j}" for j in rng.permutation(1500)[:300])) for i in range(140)]
    rows = maxent.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = [r for r in rows if r["held_out"]]
    # Half of the words follow from the one before, so the scores come near half of what words alone give.
    assert held and all(r["score"] > 0.75 * r["base_score"] for r in held)


def some_units(rng, levels=2):
    """Units of the tokens 1, 2, … and rare ones, with counts."""
    size = maxent.WIDTH ** levels
    tokens = np.sort(rng.integers(1, 2**63, size - maxent.RARE).astype(np.uint64))
    return maxent.Units(tokens, rng.permutation(len(tokens)), rng.integers(0, 50, size), rng.integers(0, 5, maxent.RARE))


def test_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(1)
    units = some_units(rng, 3)
    weights = maxent.Weights.start(units, 1 << 10)
    weights.rows = rng.normal(0, 0.3, weights.rows.shape).astype(np.float32)
    text = np.repeat(np.arange(3), [40, 1, 9])
    unit = rng.integers(0, len(units.total), len(text))
    got = weights.log_probability(maxent.contexts(text, unit, len(units.total)), unit)

    def mixed(x):
        return int(maxent.mix(np.array([x % 2**64], np.uint64))[0])

    for i in range(len(text)):
        back = [int(unit[i - j]) if i >= j and text[i - j] == text[i] else len(units.total) for j in (1, 2)]
        said = [back[0], back[0] * (len(units.total) + 1) + back[1], back[1]]
        log = 0.0
        for level in range(3):
            below = unit[i] % 16**level
            counts = [sum(units.total[u] + 0.5 for u in range(len(units.total)) if u % 16**level == below and u // 16**level % 16 == c) for c in range(16)]
            klass = sum(16**k for k in range(level)) + int(below)
            z = np.log(np.array(counts) / sum(counts))
            for kind in range(maxent.KINDS[level]):
                z += weights.rows[mixed(mixed(said[kind] + int(maxent._SALTS[kind])) + klass * int(maxent._CLASS)) % (1 << 10)]
            log += z[unit[i] // 16**level % 16] - np.log(np.exp(z).sum())
        assert abs(got[i] - log) < 1e-4


def test_probabilities_of_all_tokens_sum_to_one():
    rng = np.random.default_rng(1)
    units = some_units(rng)
    weights = maxent.Weights.start(units, 1 << 9)
    weights.rows = rng.normal(0, 0.3, weights.rows.shape).astype(np.float32)
    every = np.arange(len(units.total))
    context = maxent.contexts(np.zeros(5, np.int64), np.array([3, 1, 4, 1, 5]), len(every))[:, 4:]
    assert abs(np.exp(weights.log_probability(np.repeat(context, len(every), axis=1), every)).sum() - 1) < 1e-4
    # A shared unit's tokens: those that occur, and one that stands for all others.
    units.total[-1], units.rare_words[-1] = 12, 3
    shares = units.log_share(np.full(4, len(every) - 1), np.array([7, 4, 1, 0]))
    assert abs(np.exp(shares).sum() - 1) < 1e-9


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    unit = np.concatenate([rng.permutation(8) if i % 2 else np.arange(8) for i in range(400)]).astype(np.int64)
    units = some_units(rng)
    units.total = np.bincount(unit, minlength=len(units.total))
    weights = maxent.Weights.start(units, 1 << 12)
    rows = maxent.contexts(np.zeros(len(unit), np.int64), unit, len(units.total))
    spent, used = np.zeros(1 << 12), np.zeros(1 << 12, np.float32)
    before = weights.log_probability(rows, unit).mean()
    for _ in range(10):
        weights.train(spent, used, rows, unit)
    assert weights.log_probability(rows, unit).mean() > before + 0.3
    assert used.sum() == 10 * sum(maxent.KINDS[:2]) * len(unit)


def test_sizes_grow_with_the_lexicon():
    assert [maxent.levels_for(n) for n in (0, 900, 2000, 10**5, 10**9)] == [2, 2, 3, 4, 4]
    assert maxent.rows_for(0) < maxent.rows_for(3 * 10**5) < maxent.rows_for(3 * 10**6) < maxent.rows_for(10**10) == 1 << maxent.MAX_ROW_BITS
    assert maxent.rounds_for(0) < maxent.rounds_for(10**8) < maxent.rounds_for(10**11)


def test_changes_of_partitions_come_together():
    def sent(used, change):
        change = np.full((4, maxent.WIDTH), change, np.float32)
        scale = np.abs(change).max(axis=1) / 127
        return {"used": np.full(4, used, np.float16).tobytes(), "scale": scale.astype(np.float16).tobytes(),
                "steps": np.rint(change / np.maximum(scale, 1e-9)[:, None]).astype(np.int8).tobytes()}

    def change(*partitions):
        first = maxent._added((pa.scalar(0),), pa.Table.from_pylist([sent(*p) for p in partitions]))
        used, squares, total = (np.frombuffer(maxent._merged((pa.scalar(0),), first)[c][0].as_py(), np.float32) for c in ("used", "squares", "total"))
        return maxent.together(used, squares, total.reshape(4, maxent.WIDTH))[0, 0]

    assert abs(change((3, 0.5)) - 0.5) < 0.01  # What one partition alone has seen is kept.
    assert abs(change((50_000, 0.5), (50_000, 0.7), (50_000, 0.6)) - 0.6) < 0.01  # Of well-trained rows the mean is taken.
    assert 0.9 < change((1, 0.5), (1, 0.5), (1, 0.5), (1, 0.5)) < 1.01  # Single tokens of four partitions go twice as far.


def test_tokens_end_every_text():
    text, hashes = lexicon.tokens(Texts(pa.array(["a B", None, "", "b a"])))
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3, 3]
    assert (hashes[[2, 3, 4, 7]] == lexicon.END).all() and hashes[1] == hashes[5] and hashes[0] == hashes[6]


def test_empty_table_and_no_training_text(spark, nothing):
    assert maxent.score(nothing).collect() == []
    only = next(i for i in range(100) if held_out(i))
    (row,) = maxent.score(spark.createDataFrame([(only, "some words")], "doc_id long, text string")).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert row["score"] < 0


def test_tokens_find_their_units():
    rng = np.random.default_rng(4)
    units = some_units(rng, 3)
    units.tokens = np.sort(np.concatenate([units.tokens[:-300], units.tokens[:300] + np.uint64(1)]))  # Some with the same first bits.
    rank = dict(zip(units.tokens.tolist(), units.rank.tolist(), strict=True))
    asked = np.concatenate([units.tokens, rng.integers(1, 2**63, 500).astype(np.uint64), units.tokens[:50] + np.uint64(7)])
    rare = units.top + lexicon.rare_unit(asked, maxent.RARE)
    assert units.of(asked).tolist() == [rank.get(x, int(r)) for x, r in zip(asked.tolist(), rare, strict=True)]


def test_the_highest_logit_of_a_row_is_not_sought_along_it():
    class Seen(np.ndarray):
        along_rows = 0

        def max(self, axis=None, **options):
            Seen.along_rows += axis == 1
            return np.asarray(self).max(axis=axis, **options)

    rng = np.random.default_rng(3)
    units = some_units(rng)
    weights = maxent.Weights.start(units, 1 << 9)
    unit = rng.integers(0, len(units.total), 50)
    features = maxent.contexts(np.zeros(50, np.int64), unit, len(units.total))
    want = weights.log_probability(features, unit)
    weights.shares = weights.shares.view(Seen)
    assert (weights.log_probability(features, unit) == want).all() and Seen.along_rows == 0
    assert (maxent.highest(weights.shares) == np.asarray(weights.shares).max(axis=1)).all()


def test_slopes_of_a_row_are_added_up():
    # Most rows have one token; those are copied, not summed up one by one.
    rng = np.random.default_rng(9)
    for rows in (rng.integers(0, 3000, 2000), rng.permutation(2000), np.zeros(50, np.int64)):
        slope = rng.random((len(rows), maxent.WIDTH), dtype=np.float32)
        order = np.argsort(rows)
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        row, tokens, total = maxent.added_up(slope, rows)
        assert row.tolist() == rows[order][first].tolist() and tokens.tolist() == np.diff(np.append(first, len(rows))).tolist()
        assert np.array_equal(total, np.add.reduceat(slope[order], first, axis=0))
    columns = rng.random((300, maxent.WIDTH), dtype=np.float32)
    assert np.array_equal(maxent.column_sums(np.ascontiguousarray(columns.T)), columns.sum(axis=1))
