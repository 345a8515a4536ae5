"""Projection, filters, joins, set operations, sorts and ranking helpers.

The helpers here are the Spark way of writing what the reference did with
positions, dict lookups and Python lists:

* positions become keys (``id``) and explicit orders;
* a global or per-group row number is computed without funnelling rows
  through a single task (``row_number_by``);
* lookups against small tables are joins that AQE turns into broadcast
  joins from runtime sizes; only literal tables of fixed size are hinted.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; like pandas, fail when one of them does not exist."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def cast_scores(df: DataFrame, score: str = "score", rating: str | None = None,
                prediction: str | None = None) -> DataFrame:
    """score -> double; rating -> int truncating toward zero; prediction -> int after half-even rounding."""
    cols = {score: F.col(score).cast("double")}
    if rating:
        cols[rating] = F.col(rating).cast("int")
    if prediction:
        cols[prediction] = F.bround(F.col(prediction), 0).cast("int")
    return df.withColumns(cols)


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def filter_score_range(df: DataFrame, score: str = "score", lo: int = 1, hi: int = 10) -> DataFrame:
    """Keep scores lo..hi; 0, out-of-range and null scores are dropped."""
    return df.filter(F.col(score).between(lo, hi))


def preview(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def sample_n(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Reproducible n-row sample: the n smallest md5(key:seed) (a distributed top-k)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    """Reproducible Bernoulli sample of about ``fraction`` of the rows, chosen by a hash of the key
    (the same rows on every re-read and after executor loss, unlike ``sample``)."""
    from scorewright.functions.hashing import split_hash
    return df.filter(split_hash(F.col(key), seed) < F.lit(int(fraction * (1 << 32))))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Chain frames, duplicates kept, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """k first rows in a total order (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str | list[str], k: int, *order: Column,
                    rank_col: str = "rank") -> DataFrame:
    """k first rows per group; Spark plans a WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).filter(F.col(rank_col) <= k)


def first_per_group(df: DataFrame, group: str, order: list[Column], value_cols: list[str]) -> DataFrame:
    """First row per group in ``order`` via ``min(struct(order..., values...))``.

    A plain aggregate: map-side partial aggregation keeps one row per group
    per task, so a group holding a third of all rows costs no more than any
    other (unlike a window partitioned by the group).
    """
    fields = [o.alias(f"_o{i}") for i, o in enumerate(order)] + [F.col(c) for c in value_cols]
    best = F.min(F.struct(*fields)).alias("_best")
    return df.groupBy(group).agg(best).select(group, *[F.col(f"_best.{c}").alias(c) for c in value_cols])


def row_number_by(df: DataFrame, partition: list[str], order: list[str], name: str = "rn",
                  checkpoint: bool = True) -> DataFrame:
    """``row_number() over (partition by .. order by ..)`` without a per-group task.

    A window partitioned by a skewed key sorts a whole group in one task and
    a global window sorts the whole table in one task.  Instead: range-sort
    by (partition, order) across all tasks, tag each row with its position
    inside its task (``monotonically_increasing_id`` is consecutive within a
    task), count rows per (task, group) -- a table with at most
    tasks x groups-per-task rows -- turn the counts into starting offsets, and
    add them back.  The sorted, tagged table is checkpointed to the shared
    checkpoint folder so that both branches see the same task layout even
    after an executor loss.
    """
    keys = partition + order
    # range partitioning samples its input and then shuffles it: keep the
    # input for the two passes, release it once the checkpoint is written
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if checkpoint else df
    tagged = src.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumns({
        "_task": F.shiftright(F.col("_mid"), 33),
        "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    if checkpoint:
        tagged = tagged.checkpoint(eager=True)
        src.unpersist()
    counts = tagged.groupBy("_task", *partition).agg(F.count(F.lit(1)).alias("_n"),
                                                     F.min("_pos").alias("_first"))
    w = Window.partitionBy(*partition).orderBy("_task") if partition else Window.orderBy("_task")
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = tagged.join(offsets.select("_task", *partition, "_offset", "_first"), ["_task", *partition])
    out = out.withColumn(name, (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
    return out.drop("_mid", "_task", "_pos", "_offset", "_first")


def ntile_by(df: DataFrame, partition: list[str], order: list[str], k: int, name: str = "ntile") -> DataFrame:
    """``ntile(k)`` over a partition, from ``row_number_by`` and group sizes (no per-group task)."""
    ranked = row_number_by(df, partition, order, "_rn")
    if partition:
        sizes = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_gn"))
        j = ranked.join(sizes, partition)
    else:
        j = ranked.withColumn("_gn", F.lit(df.count()))
    q = F.floor(F.col("_gn") / k)
    r = F.col("_gn") % k
    big = r * (q + 1)
    tile = F.when(F.col("_rn") <= big, F.floor((F.col("_rn") - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((F.col("_rn") - big - 1) / q) + 1)
    return j.withColumn(name, tile.cast("int")).drop("_rn", "_gn")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n, key)`` puts in a partition each (as nearly as 64 n numbers can)."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    one = {r["place"]: r["id"] for r in spark.range(64 * n).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()}
    return [one.get(p, 64 * n + p) for p in range(n)]
