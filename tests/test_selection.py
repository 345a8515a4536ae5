"""Feature selection edge cases: zero-variance features, chi-square, F-scores."""

from pyspark.sql import functions as F

from scorewright.operators import selection as SEL


def _frame(spark):
    rows = [("t1", i, float(i % 4), 0.0, float(1 + i % 4)) for i in range(40)] + \
           [("t2", 100 + i, float(i % 3), float(i % 2), float(1 + i % 3)) for i in range(30)]
    return spark.createDataFrame(rows, "topic string, id long, x double, z double, y double")


def test_zero_variance_feature_dropped_per_topic(spark):
    kept = {(r.topic, r.feature): r.kept for r in SEL.zero_variance(_frame(spark), ["x", "z"]).collect()}
    assert kept[("t1", "z")] is False and kept[("t2", "z")] is True and kept[("t1", "x")] is True


def test_constant_column_correlation_is_null(spark):
    df = _frame(spark).filter("topic = 't1'")
    m = {(r.feature_a, r.feature_b): r.corr for r in SEL.correlation_matrix(df, ["x", "z", "y"]).collect()}
    assert m[("x", "z")] is None and m[("z", "z")] is None and abs(m[("x", "y")] - 1.0) < 1e-12
    m2 = {(r.feature_a, r.feature_b): r.corr for r in SEL.correlation_matrix(df, ["x", "z", "y"], complete=True).collect()}
    assert m2[("x", "z")] is None and m2[("z", "z")] is None and abs(m2[("x", "y")] - 1.0) < 1e-9


def test_k_best_skips_zero_variance_and_perfect_fit(spark):
    best = SEL.select_k_best_by_group(_frame(spark), ["x", "z"], "y", "topic", 10).collect()
    got = {(r.topic, r.feature) for r in best}
    assert ("t1", "z") not in got and ("t1", "x") in got
    # r = 1 gives an infinite F score, ranked first
    top = [r for r in best if r.topic == "t1" and r.feature == "x"][0]
    assert top.f == float("inf") and top.rank == 1


def test_chi2_matches_hand_computation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (2.0, 1.0), (2.0, 1.0)], "y double, x double")
    chi = SEL.chi2_scores(df, ["x"], "y").first().chi2
    # class sums 2 and 2, total 4, expected 2 and 2 -> chi2 = 0
    assert abs(chi) < 1e-12


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 5.0)], "topic string, id long, x double")
    out = {r.id: r.x for r in SEL.standard_scale(df, ["x"], "topic").collect()}
    assert out == {1: -1.0, 2: 1.0, 3: 0.0}
