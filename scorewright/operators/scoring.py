"""Per-topic score regression written as aggregates (no ML library).

The single-feature least-squares fit per topic is ``regr_slope`` /
``regr_intercept`` under one ``groupBy(topic)``: partial aggregation keeps
one buffer per topic per task, so an oversized topic is no slower than a
small one.  The coefficient table (one row per topic) is staged before it is
joined back, so Spark knows its bytes when it plans and broadcasts it while it
is below its threshold; the rows are not shuffled on the topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators import metrics


def with_split(essays: DataFrame, train_pct: int = 70, hash_col: str = "split_hash") -> DataFrame:
    return essays.withColumn("split", F.when(F.col(hash_col) % 100 < train_pct, "train").otherwise("test"))


def ols_by_topic(df: DataFrame, feature: str, target: str = "score", topic: str = "topic",
                 train_col: str | None = "split") -> DataFrame:
    """(topic, n_rows, n_train, slope, intercept): OLS of target on feature over training rows.

    ``n_rows`` counts all rows of the topic (the weight of the topic in the mean kappa).
    """
    is_train = (F.col(train_col) == "train") if train_col else F.lit(True)
    y = F.when(is_train, F.col(target).cast("double"))
    x = F.when(is_train, F.col(feature).cast("double"))
    return df.groupBy(topic).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(y).alias("n_train"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def predict_ols(df: DataFrame, coef: DataFrame, feature: str, topic: str = "topic") -> DataFrame:
    from scorewright.sources.staging import stage
    pred = F.col("intercept") + F.col("slope") * F.col(feature).cast("double")
    coef = stage(coef, "ols-coefficients")  # one row per topic, of known size when the join is planned
    return df.join(coef.select(topic, "slope", "intercept"), topic).withColumn("y_pred", pred)


def evaluate_ols_by_topic(essays: DataFrame, feature: str = "word_count", train_pct: int = 70,
                          stage: bool = True) -> DataFrame:
    """Fit per topic on the training part, predict the rest, QWK with truncated predictions.

    Output: topic, weight (all rows of the topic), n_test, slope, intercept, kappa.

    The fit and the scoring both need the feature of every essay; with
    ``stage`` the narrow (id, topic, feature, score, hash) projection is
    written once to the checkpoint folder, so the text is read and the
    feature computed in a single pass.
    """
    e = with_split(essays, train_pct).select("id", "topic", feature, "score", "split")
    if stage:
        from scorewright.sources.staging import stage as stage_table
        e = stage_table(e, "ols-input")
    coef = ols_by_topic(e, feature)
    test = predict_ols(e.filter(F.col("split") == "test"), coef, feature)
    test = test.withColumn("y_pred_int", F.col("y_pred").cast("int"))
    kap = metrics.quadratic_weighted_kappa(test, "y_pred_int", "score", "topic").withColumnRenamed("n", "n_test")
    return coef.select("topic", F.col("n_rows").alias("weight"), "slope", "intercept").join(kap, "topic", "left")
