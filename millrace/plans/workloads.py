"""The workloads from files to results, as a user runs them.

Each takes paths and settings and returns DataFrames (or a model with them). `checkpoint` switches on what a run
needs to measure the cost of checkpointing; its times go to the log of `millrace.operators.checkpoints`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import logs
from millrace.operators import clustering, failures, graph, orders, regression, runs, text
from millrace.operators.topics import TopicModel
from millrace.sources import eventlog, sinks
from millrace.sources import text as readers


def analytics(
    spark: SparkSession, items_path: str, orders_path: str, fraction: float = 1.0, checkpoint: bool = False
) -> DataFrame:
    """The five orders with the highest item total, from pipe-delimited files."""
    return orders.top_orders(
        readers.read_orders(spark, orders_path), readers.read_order_items(spark, items_path),
        fraction=fraction, checkpoint=checkpoint)


def pagerank(
    spark: SparkSession, path: str, iterations: int = 100, checkpoint_every: int = 10, save: str | None = None
) -> DataFrame:
    """node, rank of an edge-list file; written as text as well if `save` is given."""
    ranks = graph.pagerank(readers.read_edges(spark, path), iterations, checkpoint_every)
    if save is not None:
        sinks.save_ranks(ranks, save)
    return ranks


class Clusters(NamedTuple):
    model: KMeansModel
    cost: float
    centres: DataFrame


def kmeans(spark: SparkSession, path: str, k: int, iterations: int = 100, seed: int = 42) -> Clusters:
    """Centres and within-set squared error of a file of points; the parsed points are checkpointed first."""
    model = clustering.kmeans_fit(readers.read_points(spark, path), k, iterations, seed, checkpoint=True)
    return Clusters(model, model.summary.trainingCost, clustering.kmeans_centres(model, spark))


class Topics(NamedTuple):
    model: TopicModel
    avg_loglik: float
    counts: DataFrame
    terms: DataFrame


def lda(
    spark: SparkSession, corpus_path: str, stopwords_path: str, k: int, iterations: int = 100,
    checkpoint_interval: int = -1, vocab_size: int = 10_000, seed: int = 42,
) -> Topics:
    """Topics, mean log-likelihood and counts of a corpus file with one document per line."""
    extra = readers.read_stopwords(spark, stopwords_path)
    tokens = text.stopword_filter(text.tokenize(readers.read_corpus(spark, corpus_path)), extra).select("tokens")
    words, vectors = text.count_vectors(tokens, vocab_size)
    vectors = vectors.select("features").persist()
    try:
        model = text.lda_fit(vectors, k, iterations, checkpoint_interval, seed)
        loglik = text.lda_avg_loglik(model, vectors.count())
    finally:
        vectors.unpersist()
    return Topics(model, loglik, text.corpus_counts(tokens, vocab_size), text.topic_terms(model, words.vocabulary))


class Regression(NamedTuple):
    model: PipelineModel
    predictions: DataFrame
    rmse: DataFrame
    description: str


def gradient_boosted_trees(
    spark: SparkSession, path: str, iterations: int = 100, checkpoint_interval: int = -1, seed: int = 42
) -> Regression:
    """Learn on 70 % of a file of `label,f1 f2 …` rows and predict the others."""
    matrix = regression.feature_matrix(readers.read_labelled(spark, path))
    train, test = regression.split(matrix, [0.7, 0.3], seed)
    model = regression.gbt_regression(train, "label", matrix.columns[1:], iterations, checkpoint_interval, seed)
    predictions = model.transform(test).select("prediction", "label", "features")
    return Regression(model, predictions, regression.rmse(predictions), regression.describe_model(model))


def failure_study(
    spark: SparkSession, glob: str, models: str, scored: str, order: Sequence[str] = (), limit: int = 10_000,
    **settings,
) -> tuple[failures.Selection, DataFrame]:
    """Nested cross-validation on the first rows of gzip CSV files; models are kept, scored rows written.

    Returns the selection and the metrics of both steps.
    """
    rows = readers.read_capped(spark, glob, limit, order)
    model, metrics, predicted = failures.nested_cv(rows, models=models, **settings)
    sinks.write_scored(predicted, scored, files=2)
    return model, metrics


def report_run(
    spark: SparkSession, log_path: str, events_path: str, root: str, workload: str, checkpoint: bool,
    local: bool = True, app_id: str | None = None, by_rdd: bool = False, cache: str | None = None,
) -> str:
    """Write the run table of the application that a driver log names; returns its path.

    Checkpoint times are those of stages, shared by their tasks (`tcMinStage`, `tcMinTask`), or with `by_rdd` those the
    driver log gives for the last checkpointed RDD of a task's stage (`rddId`, `tcMs`). With a `cache` folder the parsed
    event log is kept there, and read from there when it is asked for again.
    """
    lines = readers.read_log(spark, log_path)
    if app_id is None:
        named = logs.log_app_id(lines, local).head()
        if named is None:
            raise ValueError(f"{log_path} names no application")
        app_id = named.app_id

    def parse() -> DataFrame:
        return runs.run_report(eventlog.read_events(spark, events_path), app_id)

    report = (readers.cached(spark, f"{cache}/{app_id}", parse) if cache else parse()).drop("app_id")
    if by_rdd:
        times = logs.zip_matches(lines).groupBy("rddId").agg(F.max("tcMs").alias("tcMs"))
        report = runs.add_tc_by_rdd(report.drop("tcMinStage", "tcMinTask"), times)
    order = ["stageId", "attemptId", "taskIndex", "taskAttempt", "taskId"]
    return sinks.write_run_table(report, root, "local" if local else "cluster", workload, app_id, checkpoint, order)
