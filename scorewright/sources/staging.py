"""Stage an intermediate table as Parquet in the shared checkpoint folder.

Writing and re-reading cuts lineage (a lost executor recomputes from the
staged files, not from the raw text) and survives the session, unlike
``cache``.  The folder comes from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.session import ensure_checkpoint_dir, scratch_path


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    target = path or scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    return df.sparkSession.read.parquet(target)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more, and let Spark drop the shuffle files of plans that are gone.

    Spark drops a shuffle's files once the driver's JVM has collected its plan, which a loop with little garbage of its
    own may not come to before the disks are full."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def remembered(spark: SparkSession, name: str, inputs: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """A fitted table, kept in the shared folder under its inputs' fingerprint: fitted once, read by whoever asks again.

    The fingerprint counts the rows of ``inputs`` and folds their hashes, so other inputs get another table."""
    got = inputs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*inputs.columns)).alias("h"),
                     F.sum(F.xxhash64(*inputs.columns, F.lit(1)).cast("decimal(38,0)")).alias("s")).first()
    key = hashlib.md5(f"{got['n']}:{got['h']}:{got['s']}".encode()).hexdigest()
    path = os.path.join(ensure_checkpoint_dir(spark), "models", f"{name}-{key}")
    done = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
