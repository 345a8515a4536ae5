"""Score the scalar predictors of essays that arrive as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import textfeat
from scorewright.sources.tables import bind_essays

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def feature_stream(spark: SparkSession, source_dir: str, glob: str = "documents*.parquet",
                   max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming frame of (id, topic, score, scalar predictors) for new document files."""
    docs = (spark.readStream.schema(DOCUMENT_SCHEMA).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    essays = bind_essays(docs).select("id", "topic", "score", "text")
    feats = textfeat.count_features(textfeat.annotate(essays))
    scalar = [c for c in textfeat.PREDICTORS if c != "similarity"]
    return feats.select("id", "topic", F.col("score").cast("double").alias("target_score"), *scalar)
