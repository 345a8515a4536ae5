"""Operators stay exact when one key holds a third of all rows."""

from pyspark.sql import Window, functions as F

from scorewright.operators import metrics, profile as P, relational as R


def _skewed(spark, n=900):
    # group "hot" holds a third of the rows; the rest spread over 60 groups
    rows = [("hot" if i % 3 == 0 else f"g{i % 60}", i, 1 + i % 5, 1 + (i * 7) % 5) for i in range(n)]
    return spark.createDataFrame(rows, "g string, id long, a int, b int").repartition(6)


def test_duplicates_with_a_hot_copy_group(spark):
    rows = [("same text",)] * 300 + [(f"text {i}",) for i in range(600)] + [(None,), (None,)]
    df = spark.createDataFrame(rows, "t string").repartition(5)
    assert P.duplicate_rows(df, ["t"]) == 299 + 1


def test_grouped_kappa_with_hot_group(spark):
    df = _skewed(spark)
    got = {r.g: r.kappa for r in metrics.quadratic_weighted_kappa(df, "a", "b", "g").collect()}
    hot = [(r.a, r.b) for r in df.filter("g = 'hot'").collect()]
    from test_kappa import matrix_qwk
    exp = matrix_qwk([x for x, _ in hot], [y for _, y in hot])
    assert abs(got["hot"] - exp) < 1e-12


def test_first_per_group_with_hot_group(spark):
    df = _skewed(spark)
    got = {r.g: r.id for r in R.first_per_group(df, "g", [-F.col("a"), F.col("id")], ["id"]).collect()}
    w = Window.partitionBy("g").orderBy(F.col("a").desc(), "id")
    exp = {r.g: r.id for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == exp


def test_top_k_per_group_with_hot_group(spark):
    df = _skewed(spark)
    top = R.top_k_per_group(df, "g", 2, F.col("a").desc(), F.col("id"))
    assert top.filter("g = 'hot'").count() == 2 and top.count() == 2 * df.select("g").distinct().count()
