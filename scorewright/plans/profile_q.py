"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import profile as P
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.sources import essays, load

E = S.ESSAYS


@query("schema_profile", """WITH c AS (SELECT count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang,
                  count(source) AS source, count(n_chars) AS n_chars FROM documents),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME column_name VALUE non_null),
t AS (SELECT column_name, CAST(row_number() OVER () - 1 AS BIGINT) AS ordinal,
             CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
                              WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS data_type
      FROM (DESCRIBE documents))
SELECT t.column_name, t.ordinal, t.data_type, u.non_null FROM t JOIN u USING (column_name)""")
def q_schema_profile(spark, sf_dir):
    return P.schema_profile(load(spark, sf_dir, "documents"))


NULL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("null_counts", "WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)\n"
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM j" for c in NULL_COLS))
def q_null_counts(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    # only whether a text is null matters: its bytes stay out of the join
    slim = d.withColumn("text", F.when(F.col("text").isNotNull(), F.lit(1)))
    return P.null_counts(slim.join(load(spark, sf_dir, "labels"), "doc_id", "left").select(*NULL_COLS))


@query("duplicate_rows", """SELECT 'text' AS columns, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS BIGINT) AS n_duplicates FROM documents
UNION ALL SELECT 'text,lang,source', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS BIGINT) FROM documents""")
def q_duplicate_rows(spark, sf_dir):
    return P.duplicate_count_frame(load(spark, sf_dir, "documents"), [["text"], ["text", "lang", "source"]])


#: Every numeric column of the essay table.
DESCRIBED = ["id", "n_chars", "word_count", "score", "split_hash", "rater1", "rater2"]


def _describe_sql(col):
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT '{col}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
            f"round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
            f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM essays")


@query("describe_numeric", f"WITH {E} " + " UNION ALL ".join(_describe_sql(c) for c in DESCRIBED))
def q_describe(spark, sf_dir):
    return rounded(P.describe_numeric(essays(spark, sf_dir), DESCRIBED))


@query("distinct_id_audit", "SELECT count(DISTINCT doc_id) AS n_distinct, count(*) AS n_rows FROM documents")
def q_distinct_audit(spark, sf_dir):
    return P.distinct_audit(load(spark, sf_dir, "documents"), "doc_id")


@query("topic_counts", f"WITH {E} SELECT topic, count(*) AS n FROM essays GROUP BY topic")
def q_topic_counts(spark, sf_dir):
    return P.group_counts(essays(spark, sf_dir), "topic")


@query("score_counts", f"WITH {E} SELECT score, count(*) AS n FROM essays GROUP BY score")
def q_score_counts(spark, sf_dir):
    return P.group_counts(essays(spark, sf_dir), "score")


def _hist_sql(feature, expr):
    return f"""(WITH v AS (SELECT CAST({expr} AS DOUBLE) AS x FROM essays),
r0 AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
b AS (SELECT CAST(least(1 + floor((x - r.lo) / ((r.hi - r.lo) / 30)), 30) AS BIGINT) AS bin FROM v, r WHERE x IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT '{feature}' AS feature, g.bin, round(r.lo + (g.bin - 1) * ((r.hi - r.lo) / 30), 6) AS bin_lo,
       round(r.lo + g.bin * ((r.hi - r.lo) / 30), 6) AS bin_hi, coalesce(c.n, 0) AS n
FROM range(1, 31) g(bin) CROSS JOIN r LEFT JOIN c ON g.bin = c.bin)"""


@query("histogram_bins", f"WITH {E} {_hist_sql('word_count', 'word_count')} UNION ALL {_hist_sql('polarity', S.sentiment_polarity('text'))}")
def q_histogram(spark, sf_dir):
    e = essays(spark, sf_dir).select("word_count", T.sentiment_polarity(F.col("text")).alias("polarity"))
    return rounded(P.histogram_bins_multi(e, ["word_count", "polarity"]))


REL_FEATURES = {
    "word_count": "word_count",
    "unique_words": f"len(list_distinct({S.whitespace_words('text')}))",
    "polarity": S.sentiment_polarity("text"),
    "readability": S.flesch("text"),
}


@query("score_relation", f"WITH {E}, f AS (SELECT score, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in REL_FEATURES.items())
       + " FROM essays) " + " UNION ALL ".join(
           f"SELECT '{k}' AS feature, count(CASE WHEN {k} IS NOT NULL AND score IS NOT NULL THEN 1 END) AS n, round(corr({k}, score), 6) AS corr, "
           f"round(regr_slope(score, {k}), 6) AS slope, round(regr_intercept(score, {k}), 6) AS intercept FROM f"
           for k in REL_FEATURES))
def q_score_relation(spark, sf_dir):
    t = F.col("text")
    e = essays(spark, sf_dir).select(
        "score", "word_count", T.unique_word_count(t).alias("unique_words"),
        T.sentiment_polarity(t).alias("polarity"), T.flesch_reading_ease(t).alias("readability"))
    return rounded(P.score_relation(e, list(REL_FEATURES)))


@query("feature_by_score", f"WITH {E} SELECT score, count(*) AS n, round(avg(word_count::DOUBLE), 6) AS mean FROM essays GROUP BY score")
def q_feature_by_score(spark, sf_dir):
    return rounded(P.feature_by_score(essays(spark, sf_dir), "word_count"))
