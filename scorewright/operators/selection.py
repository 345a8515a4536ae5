"""Feature selection: chi-square, correlations, variance filter, F-scores, top-k.

Every statistic here is a grouped aggregate over the wide feature table
(one scan), followed by arithmetic on a result that has one row per class,
topic or feature pair -- tiny tables where windows and sorts are free.

Pearson correlation is ``covar_pop / (stddev_pop * stddev_pop)`` through
``try_divide``: both moments use Spark's stable online updates, and a
constant column gives null instead of an ANSI division error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def chi2_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, chi2): sum over classes of (observed - expected)^2 / expected.

    observed = class sum of the (non-negative) feature, expected = class
    share x feature total.  Not ``ChiSquareTest``, which treats values as
    categories.
    """
    by_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"),
                                     *[F.sum(F.col(f).cast("double")).alias(f) for f in features])
    long = by_class.unpivot([label, "_nc"], features, "feature", "observed")
    w_f = Window.partitionBy("feature")
    long = long.withColumns({
        "_total": F.sum("observed").over(w_f),
        "_n": F.sum("_nc").over(w_f),
    })
    expected = F.col("_nc") / F.col("_n") * F.col("_total")
    term = F.try_divide((F.col("observed") - expected) * (F.col("observed") - expected), F.when(expected != 0, expected))
    return long.groupBy("feature").agg(F.sum(term).alias("chi2"))


def top_features(scores: DataFrame, score: str, k: int = 10) -> DataFrame:
    return scores.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "feature").limit(k)


def correlation_matrix(df: DataFrame, columns: list[str], complete: bool = False) -> DataFrame:
    """(feature_a, feature_b, i, j, corr): Pearson for all pairs; null where a column is constant.

    ``complete=True`` (no nulls in ``columns``, e.g. computed feature tables)
    uses MLlib ``Correlation.corr``: one pass, BLAS outer-product updates, a
    k x k matrix back on the driver.  Otherwise every pair gets its own
    pairwise-complete moments inside one aggregate.
    """
    if complete:
        return _mllib_correlation(df, columns)
    aggs, structs = [], []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if j < i:
                continue
            name = f"c_{i}_{j}"
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            aggs.append(safe_corr(F.when(both, xa), F.when(both, xb)).alias(name))
            structs.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                    F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"),
                                    F.col(name).alias("corr")))
            if i != j:
                structs.append(F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"),
                                        F.lit(j).cast("bigint").alias("i"), F.lit(i).cast("bigint").alias("j"),
                                        F.col(name).alias("corr")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def _mllib_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    import math

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    from pyspark import StorageLevel
    vec = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="error") \
        .transform(df.select(*[F.col(c).cast("double").alias(c) for c in columns])).select("_features")
    # Correlation makes several passes; keep the narrow vector column instead of recomputing the input
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m = Correlation.corr(vec, "_features", "pearson").first()[0].toArray()
    finally:
        vec.unpersist()
    k = len(columns)
    # MLlib puts 1.0 on the diagonal even for a constant column (whose
    # off-diagonal entries are all NaN); Pearson is undefined there.
    constant = [k > 1 and all(math.isnan(float(m[i][j])) for j in range(k) if j != i) for i in range(k)]
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            v = float(m[i][j])
            undefined = math.isnan(v) or (i == j and constant[i])
            rows.append((a, b, i, j, None if undefined else v))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, i bigint, j bigint, corr double")


def lower_triangle(matrix: DataFrame) -> DataFrame:
    """Strictly lower triangle (row index greater than column index)."""
    return matrix.filter(F.col("i") > F.col("j"))


def zero_variance(df: DataFrame, features: list[str], group: str = "topic") -> DataFrame:
    """(group, feature, std, kept): population std per group; kept when it is not 0."""
    stds = df.groupBy(group).agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features])
    long = stds.unpivot([group], features, "feature", "std")
    return long.withColumn("kept", F.coalesce(F.col("std") != 0, F.lit(False)))


def f_regression(df: DataFrame, features: list[str], target: str, group: str = "topic") -> DataFrame:
    """(group, feature, n, r, f): F = r^2 / (1 - r^2) * (n - 2) per group and feature."""
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs.append(safe_corr(F.col(f).cast("double"), y).alias(f))
    wide = df.groupBy(group).agg(*aggs)
    long = wide.unpivot([group, "_n"], features, "feature", "r")
    return long.select(group, "feature", F.col("_n").alias("n"), "r", f_score(F.col("r"), F.col("_n")).alias("f"))


def f_score(r: Column, n: Column) -> Column:
    """F = r^2 / (1 - r^2) * (n - 2), with r clamped to [-1, 1] and F = +inf for a perfect fit."""
    rc = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    r2 = rc * rc
    return F.when(r.isNull(), F.lit(None).cast("double")) \
        .when(r2 >= 1.0, F.lit(float("inf"))) \
        .otherwise(r2 / (F.lit(1.0) - r2) * (n - 2))


def select_k_best(fscores: DataFrame, kept: DataFrame, k: int = 10, group: str = "topic") -> DataFrame:
    """(group, feature, f, rank): the k best features by F per group among kept ones.

    Names come from the kept list itself (the reference indexes the full list
    with a mask over the filtered one; this is the intended meaning).
    """
    cand = fscores.join(kept.filter("kept").select(group, "feature"), [group, "feature"])
    # equal scores up to rounding noise are ties, broken by name
    w = Window.partitionBy(group).orderBy(F.round("f", 6).desc_nulls_last(), "feature")
    return cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k) \
        .select(group, "feature", "f", "rank")


def select_k_best_by_group(df: DataFrame, features: list[str], target: str, group: str = "topic",
                           k: int = 10) -> DataFrame:
    """``select_k_best`` over ``zero_variance`` and ``f_regression`` from one grouped aggregate
    (population std and correlation of every feature in a single pass)."""
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.stddev_pop(x).alias(f"s_{f}"), safe_corr(x, y).alias(f"r_{f}")]
    wide = df.groupBy(group).agg(*aggs)
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("std"),
                                       F.col(f"r_{f}").alias("r")) for f in features]))
    long = wide.select(group, "_n", rows)
    cand = long.filter(F.coalesce(F.col("std") != 0, F.lit(False))).withColumn("f", f_score(F.col("r"), F.col("_n")))
    # equal scores up to rounding noise are ties, broken by name
    w = Window.partitionBy(group).orderBy(F.round("f", 6).desc_nulls_last(), "feature")
    return cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k) \
        .select(group, "feature", "f", "rank")


def standard_scale(df: DataFrame, features: list[str], group: str | None = "topic", key: str = "id") -> DataFrame:
    """(x - mean) / population std per group; a constant column scales to 0 (like sklearn).

    Group moments come from one ``groupBy`` (partial aggregation, no task
    holds a whole group); they are staged, so Spark knows their few bytes when
    it plans the join and leaves the rows where they are.
    """
    g = [group] if group else []
    from scorewright.sources.staging import stage
    stats = df.groupBy(*g).agg(*[F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features],
                               *[F.stddev_pop(F.col(f).cast("double")).alias(f"_s_{f}") for f in features])
    j = df.join(stage(stats, "group-moments"), g) if g else _attach_scalar_stats(df, stats)
    cols = {f: F.coalesce(F.try_divide(F.col(f).cast("double") - F.col(f"_m_{f}"),
                                       F.when(F.col(f"_s_{f}") != 0, F.col(f"_s_{f}"))), F.lit(0.0))
            for f in features}
    return j.withColumns(cols).drop(*[c for c in j.columns if c.startswith("_m_") or c.startswith("_s_")])


def _attach_scalar_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    row = stats.first().asDict()
    return df.withColumns({k: F.lit(v) for k, v in row.items()})
