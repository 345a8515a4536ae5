"""Helpers shared by the training-data operators.

Intermediate tables are Parquet files in the shared folder that
``spark.checkpoint.dir`` names; writing and rereading them cuts lineage, so a
lost executor never makes an expensive step run again from the raw texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.session import scratch_path
from scorewright.sources.tables import load

#: Stands for a null document id inside the operators: it sorts after every real id.
NO_ID = (1 << 63) - 1
#: A group with more than one in HOT_SHARE of all rows is joined by broadcast: at most HOT_SHARE groups are so large.
HOT_SHARE = 2000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    for key, value in _BATCH.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): null texts become empty, null ids become ``NO_ID``; other columns are pruned."""
    prepare(docs.sparkSession)
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def public_id(name: str = "doc_id") -> Column:
    """Back from the internal id: ``NO_ID`` becomes null again."""
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    path = scratch_path(spark, name)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more (through Hadoop's file system: any store)."""
    hadoop = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with one row per ``key`` of ``groups``, safe for keys that hold a large share of all rows.

    ``size`` counts a group's rows among ``total``.  Groups above total/HOT_SHARE number at most
    HOT_SHARE whatever the input, so they are broadcast; the rest is an ordinary shuffled join
    in which no key can be hot.
    """
    limit = max(1000, total // HOT_SHARE)
    columns = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    out = [*rows.columns, *columns]
    cold = tagged.filter(F.col("_hot").isNull()).select(*rows.columns)
    return tagged.filter(F.col("_hot")).select(*out).unionByName(
        cold.join(groups.filter(F.col(size) <= limit), key, "left").select(*out))
