"""Topics of a small corpus: what must hold of any fit."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.operators import text, topics


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    kinds = [[f"{name}{i}" for i in range(8)] for name in ("sea", "sky")]
    return [" ".join(rng.choices(kinds[i % 2], k=rng.randint(5, 20))) for i in range(60)] + ["", "  "]


@pytest.fixture(scope="module")
def fitted(spark, corpus):
    return text.lda_of(spark.createDataFrame([(t,) for t in corpus], "text string"), 2, 20, checkpoint_interval=5)


def test_weights_of_a_term_add_up_to_its_count(corpus, fitted):
    model, words, _ = fitted
    count = Counter(w for t in corpus for w in t.split())
    assert words == sorted(count, key=lambda w: (-count[w], w))
    assert {r.term: sum(r.weights) for r in text.topic_weights(model, words).collect()} == pytest.approx(count)


def test_likelihood_of_tokens(spark, corpus, fitted):
    model, words, vectors = fitted
    row = text.lda_log_likelihood(model, vectors, words).head()
    tokens = sum(len(t.split()) for t in corpus)
    assert (row.n_docs, row.n_tokens) == (len(corpus), tokens)
    # Better than 16 words that are all as likely, and not as good as knowing which eight they are.
    assert tokens * math.log(1 / 16) < row.log_likelihood < tokens * math.log(1 / 8)
    nothing = text.lda_log_likelihood(model, vectors.limit(0), words).head()
    assert tuple(nothing) == (0, 0, 0.0)


def test_terms_by_topic(fitted):
    model, words, _ = fitted
    rows = text.topic_terms(model, words, 5).collect()
    topics = {t: [r.term[:3] for r in sorted(rows, key=lambda r: r["rank"]) if r.topic == t] for t in (0, 1)}
    assert sorted(map(tuple, topics.values())) == [("sea",) * 5, ("sky",) * 5]
    assert text.lda_avg_loglik(model, 62) < 0


def test_rounds_are_those_of_plain_em(spark, corpus):
    docs = [t for t in corpus if t.strip()]
    tokens = text.tokenize(spark.createDataFrame([(t,) for t in docs], "text string").coalesce(1), out="tokens")
    words, vectors = text.count_vectors(tokens)
    counts = np.stack([r.features.toArray() for r in vectors.select("features").collect()])
    document, term = np.nonzero(counts)
    n, k, rounds, seed = counts[document, term], 3, 7, 5
    drawn = np.random.default_rng([seed, zlib.crc32(term.astype(np.int32).tobytes()), zlib.crc32(n.astype(np.float32).tobytes())]).random((len(term), k))
    taken = drawn / drawn.sum(axis=1)[:, None] * n[:, None]
    alpha, eta = 50 / k + 1, 1.1
    for _ in range(rounds + 1):
        of_document, of_term = np.zeros((len(docs), k)), np.zeros((counts.shape[1], k))
        for i in range(len(term)):
            of_document[document[i]] += taken[i]
            of_term[term[i]] += taken[i]
        shares = (of_term + eta - 1) / (of_term.sum(axis=0) + len(of_term) * (eta - 1))
        taken = shares[term] * (of_document + alpha - 1)[document]
        taken *= (n / taken.sum(axis=1))[:, None]
    model = topics.fit(vectors, k, rounds, 3, seed)
    assert model.weights == pytest.approx(of_term)
    mixture = (of_document + alpha - 1) / (of_document + alpha - 1).sum(axis=1, keepdims=True)
    assert model.log_likelihood == pytest.approx((n * np.log((shares[term] * mixture[document]).sum(axis=1))).sum())


def test_documents_meet_only_their_own_terms(spark, fitted):
    model, words, vectors = fitted
    assert "posexplode" not in text.lda_log_likelihood(model, vectors, words)._jdf.queryExecution().toString()


def test_length_of_vectors_is_told_and_documents_without_terms_take_nothing(spark, corpus, monkeypatch):
    told = []
    monkeypatch.setattr(topics, "fit", lambda *a: told.append(a[-1]))
    _, words, _ = text.lda_of(spark.createDataFrame([(t,) for t in corpus], "text string"), 2, 20)
    assert told == [len(words)]  # else a pass more over all texts finds it
    block = topics.Block(np.array([0, 2, 0, 1, 0]), np.array([1, 0, 1]), np.array([1.0, 2, 4]))
    assert topics._by_document(block, np.stack([block.counts, -block.counts])).tolist() == [[0, 3, 0, 4, 0], [0, -3, 0, -4, 0]]
