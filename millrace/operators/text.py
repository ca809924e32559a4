"""From documents to topics: tokens, stop words, vocabulary, LDA."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import topics
from millrace.operators.topics import TopicModel
from millrace.session import store


def tokenize(df: DataFrame, column: str = "text", out: str = "raw_tokens") -> DataFrame:
    """Lower-cased words, split at whitespace."""
    return RegexTokenizer(inputCol=column, outputCol=out, pattern=r"\s+", gaps=True).transform(df)


def stopword_filter(
    df: DataFrame, extra: Sequence[str] = (), column: str = "raw_tokens", out: str = "tokens"
) -> DataFrame:
    """Drop the default English stop words and the `extra` ones, whatever their case."""
    words = StopWordsRemover.loadDefaultStopWords("english") + list(extra)
    return StopWordsRemover(inputCol=column, outputCol=out, stopWords=words).transform(df)


def drop_words(tokens: DataFrame, words: DataFrame, column: str = "token") -> DataFrame:
    """The rows of `tokens` (a token each) whose token, lower-cased, is none of `words`: a list of any size."""
    listed = words.select(F.lower("word").alias("__word")).distinct()
    return tokens.join(listed, F.lower(column) == F.col("__word"), "left_anti")


def term_counts(df: DataFrame, column: str = "tokens") -> DataFrame:
    """term, n_tokens, n_docs.

    A row is opened twice in one go, into all its tokens and into its distinct ones, so documents per term
    are a plain sum: no distinct count, and no shuffle of (document, term) pairs.
    """
    both = F.array(
        F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col(column).alias("terms")),
        F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct(column).alias("terms")))
    rows = df.select(F.explode(both).alias("b")).select("b.n", "b.d", F.explode("b.terms").alias("term"))
    return rows.groupBy("term").agg(F.sum("n").alias("n_tokens"), F.sum("d").alias("n_docs"))


def vocabulary(df: DataFrame, size: int = 10_000, column: str = "tokens") -> DataFrame:
    """term, n_tokens, n_docs of the `size` most frequent terms; ties by term."""
    return term_counts(df, column).orderBy(F.desc("n_tokens"), "term").limit(size)


def corpus_counts(df: DataFrame, size: int = 10_000, column: str = "tokens") -> DataFrame:
    """One row: documents, tokens, and distinct (document, term) pairs within the vocabulary.

    Tokens and pairs both come out of the stored term counts, so the texts are split only once.
    """
    terms = store(term_counts(df, column), "terms")
    parts = (
        df.agg(F.count(F.lit(1)).alias("n_docs")),
        terms.agg(F.sum("n_tokens").alias("n_tokens")),
        terms.orderBy(F.desc("n_tokens"), "term").limit(size).agg(F.sum("n_docs").alias("n_pairs")),
    )
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return one.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "n_pairs")))


def count_vectors(
    df: DataFrame, size: int = 10_000, column: str = "tokens", out: str = "features"
) -> tuple[CountVectorizerModel, DataFrame]:
    """Counts of the `size` most frequent terms, of equally frequent ones the first by name, so that all runs take the same."""
    counted = df.select(F.explode(column).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_tokens"))
    words = [r["term"] for r in counted.orderBy(F.desc("n_tokens"), "term").limit(size).select("term").collect()]
    model = CountVectorizerModel.from_vocabulary(words, column, out) if words else CountVectorizer(
        inputCol=column, outputCol=out, vocabSize=size).fit(df)
    return model, model.transform(df)


def lda_fit(
    vectors: DataFrame, k: int, iterations: int = 100, checkpoint_interval: int = -1, seed: int = 42,
    vocab_size: int | None = None,
) -> TopicModel:
    """EM-LDA over a `features` column; with an interval, checkpoints after that many iterations.

    Unless `vocab_size` tells the length of the vectors, it is found with one pass more over them.
    """
    return topics.fit(vectors, k, iterations, checkpoint_interval, seed, vocab_size)


def lda_avg_loglik(model: TopicModel, n_docs: int) -> float:
    return model.trainingLogLikelihood() / n_docs


def topic_terms(model: TopicModel, words: Sequence[str], n: int = 10) -> DataFrame:
    """topic, rank, term, weight: the `n` heaviest terms of each topic. `words` is the model's vocabulary."""
    shares = model.weights / model.weights.sum(axis=0)
    rows = [
        (topic, rank, words[i], float(shares[i, topic]))
        for topic in range(shares.shape[1])
        for rank, i in enumerate(np.argsort(-shares[:, topic], kind="stable")[:n], 1)]
    return SparkSession.getActiveSession().createDataFrame(rows, "topic int, rank int, term string, weight double")


def topic_weights(model: TopicModel, words: Sequence[str]) -> DataFrame:
    """term, weights: how often each term of the vocabulary is taken for each topic; they add up to the term's count."""
    return SparkSession.getActiveSession().createDataFrame(
        [(w, [float(x) for x in row]) for w, row in zip(words, model.weights, strict=True)], "term string, weights array<double>")


def lda_log_likelihood(model: TopicModel, vectors: DataFrame, words: Sequence[str]) -> DataFrame:
    """One row: n_docs, n_tokens and log_likelihood, the sum of log P(term | document) over the tokens of `vectors`.

    Documents may be other ones than those learned from: each takes the mixture of topics that the model infers for it.
    """
    sums = topics.likelihoods(model, vectors).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood"))
    counted = vectors.agg(F.count(F.lit(1)).alias("n_docs"))
    both = counted.unionByName(sums, allowMissingColumns=True)
    return both.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "log_likelihood")))


def lda_of(
    df: DataFrame, k: int, iterations: int = 100, checkpoint_interval: int = -1, vocab_size: int = 10_000,
    extra_stopwords: Sequence[str] = (), seed: int = 42,
) -> tuple[TopicModel, list[str], DataFrame]:
    """The model, vocabulary and count vectors of a corpus (a `text` column)."""
    tokens = stopword_filter(tokenize(df.select("text")), extra_stopwords).select("tokens")
    words, vectors = count_vectors(tokens, vocab_size)
    vectors = vectors.select("features")
    known = words.vocabulary
    return lda_fit(vectors, k, iterations, checkpoint_interval, seed, len(known)), known, vectors


def lda_topics(
    df: DataFrame, k: int, iterations: int = 100, checkpoint_interval: int = -1, vocab_size: int = 10_000,
    extra_stopwords: Sequence[str] = (), n: int = 10, seed: int = 42,
) -> DataFrame:
    """Topics of a corpus (a `text` column), from text to terms."""
    model, words, _ = lda_of(df, k, iterations, checkpoint_interval, vocab_size, extra_stopwords, seed)
    return topic_terms(model, words, n)
