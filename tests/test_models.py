"""Model invariants: elastic-net objective, persistence, importances, mixtures, seeds."""

import os
import tempfile

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorewright.operators import gram, models as M


def cd_elastic_net(X, y, alpha, l1_ratio, iters=5000):
    """Coordinate descent for 1/(2n)|y - Xw - b|^2 + alpha*r*|w|_1 + alpha*(1-r)/2*|w|^2."""
    n, p = X.shape
    xm, ym = X.mean(0), y.mean()
    Xc, yc = X - xm, y - ym
    w = np.zeros(p)
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            z = Xc[:, j] @ Xc[:, j] / n + alpha * (1 - l1_ratio)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / z
    return w, ym - xm @ w


def test_elastic_net_matches_reference_objective(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 3)) * [1.0, 3.0, 0.5]
    y = X @ [1.5, -0.7, 2.0] + rng.normal(scale=0.8, size=300) + 4.0
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)],
                               "x1 double, x2 double, x3 double, label double")
    pipe = M.elastic_net(["x1", "x2", "x3"], "label", alpha=0.1, l1_ratio=0.5, label_std=float(np.std(y)),
                         max_iter=1000, tol=1e-12)
    lr = pipe.fit(df).stages[-1]
    w, b = cd_elastic_net(X, y, 0.1, 0.5)
    assert np.allclose(lr.coefficients.toArray(), w, atol=1e-5)
    assert abs(lr.intercept - b) < 1e-5


def _frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(int(rng.integers(1, 4)))) for i in range(120)]
    return spark.createDataFrame(rows, "id long, a double, b double, label double")


def test_save_and_load_predict_equally(spark):
    df = _frame(spark)
    model = M.linear_regression(["a", "b"]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="sw-model-"), "m")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path)
    p1 = {r.id: r.prediction for r in model.transform(df).collect()}
    p2 = {r.id: r.prediction for r in again.transform(df).collect()}
    assert p1 == p2


def test_random_forest_importances_sum_to_one_and_seeded(spark):
    df = _frame(spark)
    m1 = M.random_forest(["a", "b"], num_trees=5, max_depth=3).fit(df)
    m2 = M.random_forest(["a", "b"], num_trees=5, max_depth=3).fit(df)
    imp = m1.stages[-1].featureImportances.toArray()
    assert abs(imp.sum() - 1.0) < 1e-9
    assert list(imp) == list(m2.stages[-1].featureImportances.toArray())


def test_forest_rows_keep_their_nodes_and_predict_the_same(spark):
    df = _frame(spark)
    pipe = M.random_forest(["a", "b"], num_trees=8, max_depth=12)
    assert pipe.getStages()[-1].getCacheNodeIds()
    walked = M.random_forest(["a", "b"], num_trees=8, max_depth=12)
    walked.getStages()[-1].setCacheNodeIds(False)
    one, two = ({r.id: r.prediction for r in p.fit(df).transform(df).collect()} for p in (pipe, walked))
    assert one == two and len(set(one.values())) > 10


def test_svc_classes_reindexed(spark):
    df = _frame(spark).withColumn("target", F.col("label") * 3)  # classes 3, 6, 9: a gap-ful label set
    out = M.fit_predict_classifier(df, df, ["a", "b"], "target", max_iter=5)
    assert {r.prediction for r in out.select("prediction").distinct().collect()} <= {3.0, 6.0, 9.0}


def test_lda_mixtures_sum_to_one(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    docs = spark.createDataFrame([(i, (["apple", "pear"] if i % 2 else ["car", "road", "car"]) * 3) for i in range(20)],
                                 "id long, terms array<string>")
    counts = CountVectorizer(inputCol="terms", outputCol="counts").fit(docs).transform(docs)
    lda = LDA(k=2, maxIter=5, optimizer="online", seed=0, featuresCol="counts").fit(counts)
    sums = lda.transform(counts).select(F.aggregate(vector_to_array("topicDistribution"), F.lit(0.0),
                                                    lambda s, x: s + x).alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-6 for r in sums)


def test_tuning_picks_minimum(spark):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(_frame(spark))
    train, val = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    trials = M.tune_on_validation(train, val, lambda p, s: M.gbt(max_iter=p["maxIter"], depth=2, seed=s),
                                  {"maxIter": [2, 5, 8]}, trials=3, runs=2)
    rows = trials.collect()
    assert len(rows) == 3 and min(r.val_mse for r in rows) == trials.agg(F.min("val_mse")).first()[0]


def test_gram_fits_match_coordinate_descent(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(240, 4)) @ rng.normal(size=(4, 4)) * [1.0, 30.0, 0.1, 1.0]
    X = np.column_stack((X, np.full(240, 3.0)))  # a constant gets no weight
    y = X[:, :4] @ [1.0, 0.05, 4.0, 0.0] + rng.normal(size=240)
    rows = [(i % 2, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "topic int, a double, b double, c double, d double, e double, y double").repartition(3)
    for alpha, ratio in ((0.1, 0.01), (0.5, 0.5), (1.0, 0.9)):
        fits = {r["topic"]: r for r in gram.elastic_nets(df, list("abcde"), "y", ["topic"], alpha, ratio).collect()}
        for t in (0, 1):
            w, b = cd_elastic_net(X[t::2, :4], y[t::2], alpha, ratio, iters=3000)
            assert np.allclose(fits[t]["coefficients"], [*w, 0.0], atol=1e-6)
            assert abs(fits[t]["intercept"] - b) < 1e-5 and fits[t]["n_train"] == 120


def test_grid_search_reads_folds_off_the_matrices(spark):
    rng = np.random.default_rng(6)
    X, folds = rng.normal(size=(150, 3)), np.arange(150) % 5
    y = X @ [2.0, -1.0, 0.0] + rng.normal(size=150)
    df = spark.createDataFrame([("t", int(f), x.tolist(), float(v)) for f, x, v in zip(folds, X, y)],
                               "topic string, fold int, x array<double>, y double")
    found = gram.grid_search(df, "x", "y", "topic", "fold", [0.01, 0.1, 1.0], [0.1, 0.9]).collect()
    assert len(found) == 6 and sum(r["best"] for r in found) == 1
    for r in found:
        scores = []
        for f in range(5):
            w, b = cd_elastic_net(X[folds != f], y[folds != f], r["alpha"], r["l1_ratio"], iters=300)
            e = y[folds == f] - X[folds == f] @ w - b
            scores.append(1 - (e @ e) / ((y[folds == f] - y[folds == f].mean()) ** 2).sum())
        assert abs(r["cv_r2"] - np.mean(scores)) < 1e-6
    top = max(found, key=lambda r: r["cv_r2"])
    assert top["best"] and np.allclose(top["coefficients"], cd_elastic_net(X, y, top["alpha"], top["l1_ratio"], 300)[0], atol=1e-5)

def test_successive_halving_keeps_best_third(spark):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(_frame(spark))
    train, val = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    rounds = M.successive_halving(train, val, lambda p, budget, s: M.gbt(max_iter=budget, depth=p["d"], seed=s),
                                  {"d": [1, 2, 3]}, min_budget=2, factor=3, max_budget=6).collect()
    first = [r for r in rounds if r["round"] == 0]
    second = [r for r in rounds if r["round"] == 1]
    assert len(first) == 3 and len(second) == 1 and second[0].budget == 6
    assert second[0].params == min(first, key=lambda r: (r.val_mse, r.params)).params
