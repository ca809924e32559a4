from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, generators, graph, orders, regression, text
from millrace.operators.checkpoints import checkpoint_timed
from millrace.sources import text as readers


# --- orders ------------------------------------------------------------------------------------------------

ORDERS = [(1, "2021-01-01"), (2, "2021-01-02"), (3, "2021-01-03"), (4, "2021-01-04"), (4, "2021-01-05"), (1, "2021-01-01")]
ITEMS = [(1, "5.00"), (1, "1.25"), (2, "12.50"), (3, None), (4, "7.00"), (9, "99.00")]


def order_frames(spark):
    items = [(i, None if p is None else Decimal(p)) for i, p in ITEMS]
    return (spark.createDataFrame(ORDERS, "order_id int, order_date string"),
            spark.createDataFrame(items, "order_id int, goods_price decimal(18,2)"))


@pytest.mark.parametrize("checkpoint", [False, True])
def test_top_orders(spark, checkpoint):
    """Order 1 is listed twice, order 4 with two dates, order 3 has no price, item 9 no order."""
    got = [tuple(r) for r in orders.top_orders(*order_frames(spark), checkpoint=checkpoint).collect()]
    assert got == [(2, "2021-01-02", 12.5), (1, "2021-01-01", 12.5), (4, "2021-01-05", 7.0), (4, "2021-01-04", 7.0),
                   (3, "2021-01-03", None)]
    assert orders.top_orders(*order_frames(spark), n=2, checkpoint=checkpoint).count() == 2


def test_joined_orders_keep_one_key(spark):
    joined = orders.join_orders(*order_frames(spark))
    assert joined.columns == ["order_id", "order_date", "goods_price"] and joined.count() == 8


def test_totals_of_a_hot_order(spark):
    items = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order_id"), F.lit(1.0).alias("goods_price"))
    every = spark.range(9000).select(F.col("id").alias("order_id"), F.lit("d").alias("order_date"))
    totals = {r.order_id: r.sum_goods_price for r in orders.order_totals(every, items).collect()}
    assert totals[0] == 3000.0 and len(totals) == 6001 and sum(totals.values()) == 9000


def test_a_checkpoint_cuts_the_lineage(spark, caplog):
    df = spark.range(100).filter("id > 5")
    kept, seconds = checkpoint_timed(df, "numbers")
    assert seconds > 0 and kept.count() == 94
    assert "Filter" not in kept._jdf.queryExecution().optimizedPlan().toString()


# --- graph -------------------------------------------------------------------------------------------------

def ranks_by_hand(edges, rounds):
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
    ranks = {a: 1.0 for a in links}
    for _ in range(rounds):
        sums = defaultdict(float)
        for a, targets in links.items():
            if a in ranks:
                for b in targets:
                    sums[b] += ranks[a] / len(targets)
        ranks = {b: 0.15 + 0.85 * s for b, s in sums.items()}
    return ranks


def some_edges():
    """A hub with a third of the edges, duplicates, self-loops, nodes without in-links or out-links."""
    rng = random.Random(9)
    edges = [("hub", f"n{rng.randrange(120)}") for _ in range(200)]
    edges += [(f"n{rng.randrange(60)}", rng.choice(["hub", f"n{rng.randrange(120)}"])) for _ in range(400)]
    return edges + edges[:50] + [("n1", "n1"), ("lonely", "n1")]


@pytest.mark.parametrize("rounds, every, hot", [(1, 0, 10**6), (4, 0, 10**6), (4, 0, 25), (7, 2, 25), (12, 5, 10**6)])
def test_pagerank(spark, rounds, every, hot):
    df = spark.createDataFrame(some_edges(), "src string, dst string").repartition(5)
    got = {r.node: r.rank for r in graph.pagerank(df, rounds, every, hot).collect()}
    want = ranks_by_hand(some_edges(), rounds)
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n], rel=1e-9) for n in want)
    assert "lonely" not in got


def test_pagerank_frees_its_cache(spark):
    spark.catalog.clearCache()
    graph.pagerank(spark.createDataFrame(some_edges(), "src string, dst string"), 2, 0)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_out_degree_counts_distinct_neighbours(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "b")], "src string, dst string")
    assert {r.src: r.degree for r in graph.out_degree(df).collect()} == {"a": 2, "b": 1}


# --- clustering --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [clustering.MAX_COORDINATES, 9])
def test_nearest_centre(spark, limit):
    rng = np.random.default_rng(0)
    points, centres = rng.normal(size=(300, 4)), rng.normal(size=(7, 4))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, point array<double>")
    cs = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    distances = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    got = {r.id: (r.cluster, r.distance) for r in clustering.kmeans_assign(df, cs, max_coordinates=limit).collect()}
    for i, row in enumerate(distances):
        assert got[i] == (row.argmin(), pytest.approx(row.min()))
    assert clustering.kmeans_cost(df, cs).head().cost == pytest.approx(distances.min(axis=1).sum())


def test_group_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "g string, point array<float>")
    assert {r.cluster: r.centre for r in clustering.group_means(df, "g").collect()} == {"a": [2.0, 3.0], "b": [0.0, 1.0]}


@pytest.mark.parametrize("checkpoint", [False, True])
def test_kmeans_finds_generated_clusters(spark, checkpoint):
    df = generators.gen_clusters(spark, 600, 3).select("point")
    model = clustering.kmeans_fit(df, 3, 20, seed=5, checkpoint=checkpoint)
    cost = model.summary.trainingCost
    assert cost < clustering.kmeans_fit(df, 2, 20).summary.trainingCost
    summary = clustering.kmeans_summary(model, df).collect()
    assert sum(r.size for r in summary) == 600 and sum(r.cost for r in summary) == pytest.approx(cost)
    again = clustering.kmeans_fit(df, 3, 20, seed=5, checkpoint=checkpoint)
    assert np.allclose(model.clusterCenters(), again.clusterCenters())


# --- generators --------------------------------------------------------------------------------------------

def test_generated_rows_depend_on_their_id_only(spark):
    few, many = (generators.polynomial_rows(spark.range(0, 2000, numPartitions=n), 3).orderBy("id").collect()
                 for n in (1, 7))
    assert few == many
    assert generators.gen_polynomial(spark, 2000, 3, seed=1).orderBy("id").collect() != few


def test_generated_rows_follow_their_distribution(spark):
    rows = generators.gen_polynomial(spark, 20_000, 4).collect()
    x = np.array([r.features[1] for r in rows])
    noise = np.array([r.label for r in rows]) - (2 * x + 10)
    assert all(r.features[0] == 1.0 and r.features[3] == pytest.approx(r.features[1] ** 3) for r in rows[:100])
    assert 0 < x.min() and x.max() < 10 and abs(x.mean() - 5) < 0.1 and abs(x.std() - 10 / 12**0.5) < 0.05
    assert abs(noise.mean()) < 0.1 and abs(noise.std() - 3) < 0.1 and abs(np.corrcoef(x, noise)[0, 1]) < 0.03
    points = generators.gen_clusters(spark, 20_000, 5).collect()
    sizes = Counter(r.cluster for r in points)
    assert set(sizes) == set(range(5)) and min(sizes.values()) > 3700
    of_one = np.array([r.point for r in points if r.cluster == 2])
    assert np.allclose(of_one.std(axis=0), 0.012, atol=0.001)


def test_generated_files_read_back(spark, folder):
    rows = generators.gen_polynomial(spark, 50, 4)
    path = generators.write_labelled(rows, f"{folder}/sgd")
    matrix = regression.feature_matrix(readers.read_labelled(spark, path))
    assert matrix.columns == ["label", "feature0", "feature1", "feature2", "feature3"]
    assert sorted(r.label for r in matrix.collect()) == sorted(r.label for r in rows.collect())
    points = generators.gen_clusters(spark, 50, 4)
    back = readers.read_points(spark, generators.write_points(points, f"{folder}/points"))
    assert sorted(r.point for r in back.collect()) == sorted(r.point for r in points.collect())


# --- regression --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark):
    rows = generators.gen_polynomial(spark, 3000, 4)
    labelled = rows.select(F.col("label").cast("string"), F.concat_ws(" ", F.col("features").cast("array<string>")).alias(
        "features"))
    matrix = regression.feature_matrix(labelled)
    train, test = regression.split(matrix, [0.7, 0.3], 7)
    return matrix, test, regression.gbt_regression(train, "label", matrix.columns[1:], 6, checkpoint_interval=2)


def test_regression_learns(fitted):
    matrix, test, model = fitted
    predicted = model.transform(test)
    assert test.count() > 700
    error = regression.rmse(predicted).head().rmse
    assert error < matrix.agg(F.stddev("label")).head()[0] * 0.7
    from pyspark.ml.evaluation import RegressionEvaluator
    assert error == pytest.approx(RegressionEvaluator(labelCol="label").evaluate(predicted))


def test_models_describe_themselves(fitted):
    assert "Tree 0" in regression.describe_model(fitted[2])
    assert fitted[2].stages[-1].getOrDefault("checkpointInterval") == 2


def test_rows_of_equal_features_are_one_to_the_learner(spark):
    rows = [(float(i % 3), float(i % 5), float((i * 7) % 11)) for i in range(300)]
    train = spark.createDataFrame(rows, "a double, b double, y double")
    model = regression.gbt_regression(train, "y", ["a", "b"], 3)
    assert model.stages[-1].getOrDefault("weightCol") == regression.WEIGHT
    from pyspark.ml.regression import GBTRegressor
    each = GBTRegressor(labelCol="y", featuresCol="features", maxIter=3, seed=42).fit(regression.assemble(train, ["a", "b"]))
    cases = train.select("a", "b").distinct()
    want = {(r.a, r.b): r.prediction for r in each.transform(regression.assemble(cases, ["a", "b"])).collect()}
    got = {(r.a, r.b): r.prediction for r in model.transform(cases).collect()}
    assert len(got) == 15
    assert got == pytest.approx(want)
    with pytest.raises(Exception, match="(?i)null"):
        regression.gbt_regression(train.unionByName(train.limit(1).withColumn("y", F.lit(None).cast("double"))), "y", ["a", "b"], 1)


def test_assembling_keeps_invalid_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert regression.assemble(df, ["a", "b"]).count() == 2


def test_split_by_key_follows_the_key(spark):
    df = spark.range(1000).withColumn("name", F.concat(F.lit("x"), F.col("id")))
    parts = regression.split_by_key(df, "id", [5, 3, 2]).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {0: 500, 1: 300, 2: 200}
    once, twice = (regression.split_by_key(df.repartition(n), "name", [1, 1]).orderBy("id").collect() for n in (2, 5))
    assert once == twice and 400 < sum(r.part for r in once) < 600


# --- text --------------------------------------------------------------------------------------------------

CORPUS = ["The bacău Bridge  bridge\tthe can't", "", "a   ", "bridge ÜBER über x", "x y x"]


@pytest.fixture(scope="module")
def tokens(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id int, text string")
    return text.stopword_filter(text.tokenize(df), ["Y"]).persist()


def test_tokens_without_stopwords(tokens):
    rows = {r.doc_id: r for r in tokens.collect()}
    assert rows[0].raw_tokens == ["the", "bacău", "bridge", "bridge", "the", "can't"]
    assert [rows[i].tokens for i in range(5)] == [
        ["bacău", "bridge", "bridge"], [], [], ["bridge", "über", "über", "x"], ["x", "x"]]


def test_vocabulary(tokens):
    got = [tuple(r) for r in text.vocabulary(tokens).collect()]
    assert got == [("bridge", 3, 2), ("x", 3, 2), ("über", 2, 1), ("bacău", 1, 1)]
    model, vectors = text.count_vectors(tokens)
    assert set(model.vocabulary) == {term for term, _, _ in got}
    assert sum(v.features.numNonzeros() for v in vectors.collect()) == 6


def test_corpus_counts(tokens):
    assert tuple(text.corpus_counts(tokens).head()) == (5, 9, 6)
    assert tuple(text.corpus_counts(tokens, 2).head()) == (5, 9, 4)
    assert tuple(text.corpus_counts(tokens.limit(0)).head()) == (0, 0, 0)


def test_topics(spark):
    rng = random.Random(2)
    themes = [["river", "bank", "water", "boat"], ["court", "judge", "law", "trial"]]
    docs = [(i, " ".join(rng.choice(themes[i % 2]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    topics = text.lda_topics(df, 2, 15, checkpoint_interval=5, n=4).collect()
    assert len(topics) == 8 and all(0 < r.weight <= 1 for r in topics)
    for topic in (0, 1):
        rows = sorted((r for r in topics if r.topic == topic), key=lambda r: r["rank"])
        assert [r.weight for r in rows] == sorted((r.weight for r in rows), reverse=True)
    tops = {r.topic: {x.term for x in topics if x.topic == r.topic} for r in topics}
    assert sorted(map(sorted, tops.values())) == sorted(map(sorted, themes))


def test_log_likelihood_per_document(spark):
    df = spark.createDataFrame([("a b c d",), ("b c d e",)], "text string")
    words, vectors = text.count_vectors(text.tokenize(df), column="raw_tokens")
    model = text.lda_fit(vectors, 2, 3)
    assert text.lda_avg_loglik(model, 2) == pytest.approx(model.trainingLogLikelihood() / 2) and len(words.vocabulary) == 5


def test_corpus_files(spark, folder):
    with open(f"{folder}/corpus", "w") as file:
        file.write("one two\n\nthree\n")
    docs = readers.read_corpus(spark, f"{folder}/corpus").orderBy("doc_id").collect()
    assert [r.text for r in docs] == ["one two", "", "three"] and len({r.doc_id for r in docs}) == 3
