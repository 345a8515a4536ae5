"""Profiling aggregates: every profile is one scan with all measures in one ``agg``."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _rows(structs):
    """1-row frame of k structs -> k rows (``inline``): a per-column table without k scans."""
    return F.inline(F.array(*structs))


def schema_profile(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, data_type, non_null) per column."""
    counts = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).cast("bigint").alias("ordinal"),
                        F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"c{i}").alias("non_null"))
               for i, f in enumerate(df.schema.fields)]
    return df.agg(*counts).select(_rows(structs))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null) per column."""
    sums = [F.sum(F.col(f"`{c}`").isNull().cast("bigint")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    structs = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_null"))
               for i, c in enumerate(df.columns)]
    return df.agg(*sums).select(_rows(structs))


def row_digest(cols: list[str]):
    """SHA-256 of a row's values: each is marked as null or preceded by its length, so no two rows run together."""
    parts = []
    for c in cols:
        v = F.col(f"`{c}`").cast("string")
        parts.append(F.when(v.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(v).cast("string"), F.lit(":"), v)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> int:
    """Rows equal to an earlier row on ``cols`` (nulls equal) = n - number of distinct rows."""
    return duplicate_count_frame(df, [cols or df.columns]).first()["n_duplicates"]


def duplicate_count_frame(df: DataFrame, column_sets: list[list[str]], name: str = "n_duplicates") -> DataFrame:
    """(columns, n_duplicates) per column set, from one scan.

    Only 32-byte digests are shuffled, never a text, and equal ones are counted map-side first.
    """
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(",".join(cols)).alias("columns"), row_digest(cols).alias("_d"))
                                        for cols in column_sets])))
    groups = rows.groupBy("columns", "_d").agg(F.count(F.lit(1)).alias("_n"))
    counts = groups.groupBy("columns").agg(F.sum(F.col("_n") - 1).cast("bigint").alias(name))
    sets = df.sparkSession.createDataFrame([(",".join(c),) for c in column_sets], "columns string")
    return sets.join(counts, "columns", "left").select("columns", F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def exact_quantiles(df: DataFrame, cols: list[str], qs=(0.25, 0.5, 0.75)) -> dict[str, list]:
    """Exact linearly interpolated quantiles of several columns, computed across all tasks.

    Rows are reduced to (column, value, count) first, so a value that many rows share is
    one row.  The distinct values are range-partitioned, each task's counts are summed up
    in order, the tasks' totals give the offsets, and the order statistics around each
    quantile position (at most 2 x len(qs) per column) come back to the driver.
    """
    from pyspark.sql import Window

    from scorewright.sources.staging import stage
    vals = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                 F.col(f"`{c}`").cast("double").alias("value")) for c in cols])))
    counts = vals.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.repartitionByRange("column_name", "value").withColumn("_task", F.spark_partition_id()),
                   "value-counts")
    totals = counts.groupBy("_task", "column_name").agg(F.sum("n").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("column_name").orderBy("_task")) - F.col("_n")
    totals = stage(totals.withColumn("_ahead", ahead).select("_task", "column_name", "_ahead", "_n"), "value-offsets")
    sizes = {r["column_name"]: r["n"] for r in totals.groupBy("column_name").agg(F.sum("_n").alias("n")).collect()}
    wanted = []
    for c in cols:
        n = sizes.get(c, 0)
        for q in qs:
            if n:
                pos = (n - 1) * q
                wanted += [(c, int(pos) + 1), (c, min(int(pos) + 2, n))]
    if not wanted:
        return {c: [None] * len(qs) for c in cols}
    picks = df.sparkSession.createDataFrame(sorted(set(wanted)), "column_name string, rn bigint")
    upto = F.sum("n").over(Window.partitionBy("_task", "column_name").orderBy("value")) + F.col("_ahead")
    ranked = counts.join(totals.drop("_n"), ["_task", "column_name"]).withColumn("_upto", upto)
    hit = (F.col("rn") <= F.col("_upto")) & (F.col("rn") > F.col("_upto") - F.col("n"))
    found = ranked.withColumnRenamed("column_name", "_c").join(F.broadcast(picks), (F.col("_c") == F.col("column_name")) & hit)
    got = {(r["column_name"], r["rn"]): r["value"] for r in found.select("column_name", "rn", "value").collect()}
    out = {}
    for c in cols:
        n = sizes.get(c, 0)
        res = []
        for q in qs:
            if not n:
                res.append(None)
                continue
            pos = (n - 1) * q
            lo, hi = got[(c, int(pos) + 1)], got[(c, min(int(pos) + 2, n))]
            res.append(lo + (pos - int(pos)) * (hi - lo))
        out[c] = res
    return out


def describe_numeric(df: DataFrame, cols: list[str] | None = None, exact: bool = True,
                     accuracy: int = 10000) -> DataFrame:
    """(column_name, count, mean, std, min, p25, p50, p75, max); nulls skipped; std with n-1.

    ``exact`` quantiles use ``exact_quantiles`` (counts of distinct values, no
    per-column buffer); ``exact=False`` uses ``percentile_approx`` in the
    same single aggregate pass.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if exact:
        # two passes (value counts, moments) over a narrow numeric projection
        df = df.select(*[F.col(f"`{c}`") for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _describe(df, cols, exact, accuracy)
    finally:
        if exact:
            df.unpersist()


def _describe(df: DataFrame, cols: list[str], exact: bool, accuracy: int) -> DataFrame:
    aggs, structs = [], []
    quant = exact_quantiles(df, cols) if exact else None
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if exact:
            q = [F.lit(v).cast("double") for v in quant[c]]
        else:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"q{i}"))
            q = [F.col(f"q{i}")[k] for k in range(3)]
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), q[0].alias("p25"),
            q[1].alias("p50"), q[2].alias("p75"), F.col(f"hi{i}").alias("max")))
    out = df.agg(*aggs).select(F.inline(F.array(*structs)))
    if not exact:
        return out
    # k rows, one per column: materialise them while the projection is cached
    rows = out.collect()
    return df.sparkSession.createDataFrame(rows, out.schema)


def distinct_audit(df: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """(n_distinct, n_rows): distinct non-null keys vs rows."""
    d = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return df.agg(d.cast("bigint").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


def group_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram_bins(df: DataFrame, col: str, bins: int = 30, name: str | None = None) -> DataFrame:
    """(feature, bin, bin_lo, bin_hi, n): equal-width bins from min to max, last bin closed,
    empty bins present with 0.  A constant column is widened to +-0.5 (as numpy does)."""
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.lit(1) + F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins)).cast("bigint")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        F.lit(name or col).alias("feature"), "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def histogram_bins_multi(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """``histogram_bins`` for several columns: one min/max aggregate and one binned count over a
    persisted narrow projection (the source, e.g. text features, is computed once)."""
    df = df.select(*[F.col(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _histograms(df, cols, bins)
    finally:
        df.unpersist()


def _histograms(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    xs = {c: F.col(c).cast("double") for c in cols}
    row = df.agg(*[F.min(x).alias(f"lo_{c}") for c, x in xs.items()],
                 *[F.max(x).alias(f"hi_{c}") for c, x in xs.items()]).first()
    ranges = {}
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            lo, hi = 0.0, 1.0
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        ranges[c] = (lo, hi, (hi - lo) / bins)
    structs = [F.struct(F.lit(c).alias("feature"),
                        F.least(F.lit(1) + F.floor((xs[c] - F.lit(lo)) / F.lit(w)), F.lit(bins)).cast("bigint").alias("bin"))
               for c, (lo, hi, w) in ranges.items()]
    counts = df.select(F.inline(F.array(*structs))).filter(F.col("bin").isNotNull()) \
        .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    # at most bins x len(cols) rows
    got = {(r["feature"], r["bin"]): r["n"] for r in counts.collect()}
    rows = [(c, b, lo + (b - 1) * w, lo + b * w, got.get((c, b), 0)) for c, (lo, hi, w) in ranges.items()
            for b in range(1, bins + 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, bin bigint, bin_lo double, bin_hi double, n bigint")


def score_relation(df: DataFrame, features: list[str], score: str = "score") -> DataFrame:
    """(feature, n, corr, slope, intercept) of score on each feature, pairwise-complete."""
    y = F.col(score).cast("double")
    aggs, structs = [], []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}"), F.corr(x, y).alias(f"r{i}"),
                 F.regr_slope(y, x).alias(f"b{i}"), F.regr_intercept(y, x).alias(f"a{i}")]
        structs.append(F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("corr"),
                                F.col(f"b{i}").alias("slope"), F.col(f"a{i}").alias("intercept")))
    return df.agg(*aggs).select(_rows(structs))


def feature_by_score(df: DataFrame, feature: str, score: str = "score") -> DataFrame:
    """(score, n, mean): the per-score mean behind a scatter plot."""
    return df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(feature).cast("double")).alias("mean"))
