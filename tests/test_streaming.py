"""The per-essay predictors run unchanged on a streaming source."""

from conftest import SF_SMALL

from scorewright.streaming import feature_stream


def test_feature_stream_matches_batch(spark):
    stream = feature_stream(spark, SF_SMALL)
    q = stream.writeStream.format("memory").queryName("sw_features").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT count(*) AS n, sum(token_count) AS t FROM sw_features").first()
    from pyspark.sql import functions as F

    from scorewright.operators import textfeat
    from scorewright.sources import essays
    batch = textfeat.count_features(textfeat.annotate(essays(spark, SF_SMALL).select("id", "topic", "score", "text")))
    exp = batch.agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t")).first()
    assert (got.n, got.t) == (exp.n, exp.t)
