"""The corpus pipeline: stages that each apply one training-data operator to what the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  Each result is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.

A stage that decides per document joins its decisions back by doc_id and a hash of the
text, so no row goes for the fault of another under the same id or without one.  The
exact stage keeps one row of those with equal texts.  Rows without an id sort last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import documents, stage
from scorewright.llm.decontam import decontaminate
from scorewright.llm.exact_dedup import exact_dedup, normalised
from scorewright.llm.near_dedup import near_dedup
from scorewright.llm.packing import pack
from scorewright.llm.queries import documents_quality
from scorewright.sources.tables import load


def _without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """``docs`` but for the rows in ``dropped`` (doc_id, key); ``key`` tells the texts of rows with one id or none apart."""
    return _matched(docs, dropped.distinct(), key, "left_anti").select(*docs.columns)


def _matched(docs: DataFrame, some: DataFrame, key: Column, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, key) is (not) in ``some``, with the key as last column, under a name that is free."""
    name = "_key"
    while name in map(str.lower, docs.columns):
        name += "_"
    keyed = docs.withColumn(name, key)
    some = some.select(F.col("doc_id").alias("_some"), F.col("key").alias("_some_key"))
    return keyed.join(some, keyed["doc_id"].eqNullSafe(some["_some"]) & (keyed[name] == some["_some_key"]), how)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents judged bad or toxic go."""
    return documents_quality(spark, docs, sf_dir, keep_text=True).filter("kept").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact de-duplication: the smallest doc_id of equal texts stays, once."""
    decided, _ = stage(exact_dedup(docs).withColumnRenamed("text_sha256", "key"), "exact-decisions")
    digest = F.sha2(normalised(F.coalesce("text", F.lit(""))), 256)
    each = decided.groupBy("doc_id", "key").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    # written first, so that Spark knows how few the repeats under one id are and does not shuffle all texts for them
    again, _ = stage(each.filter("kept AND n > 1").select("doc_id", "key"), "exact-repeats")
    rest = _without(docs, each.filter("NOT kept OR n > 1").select("doc_id", "key"), digest)
    repeated = _matched(docs, again, digest, "left_semi")
    return rest.unionByName(repeated.dropDuplicates(["doc_id", repeated.columns[-1]]).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates: the smallest doc_id of each class stays."""
    decided, _ = stage(near_dedup(docs, with_key=True).filter("NOT kept").select("doc_id", "key"), "near-decisions")
    return _without(docs, decided, _text_key())


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with at least a twentieth of their words in benchmark windows go."""
    # the decision is the text's, so its hash takes the place of the id
    found = decontaminate(docs.select(_text_key().alias("doc_id"), "text"), load(spark, sf_dir, "benchmark"))
    decided, _ = stage(found.filter("contaminated").select(F.col("doc_id").alias("_gone")).distinct(), "benchmark-decisions")
    return docs.join(decided, _text_key().eqNullSafe(decided["_gone"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all remaining documents in windows of 1024 tokens."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: A trained classifier, weighted samples and a tokeniser have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs, _ = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
