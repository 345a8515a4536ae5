"""Sources, sinks, projection, filters and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import relational as R
from scorewright.plans import sql as S
from scorewright.plans.catalog import query
from scorewright.session import scratch_path
from scorewright.sources import delimited, essays, load, staging

E = S.ESSAYS

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("scan_delimited", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_scan_delimited(spark, sf_dir):
    """documents -> headered Latin-1 TSV -> read back with a declared schema."""
    path = scratch_path(spark, "documents-tsv")
    delimited.write_delimited(load(spark, sf_dir, "documents"), path)
    return delimited.read_delimited(spark, path, DOC_SCHEMA)


@query("csv_round_trip", f"WITH {E} SELECT id AS essay_id, text AS essay, score AS domain1_score FROM essays")
def q_csv_round_trip(spark, sf_dir):
    e = essays(spark, sf_dir).select(F.col("id").alias("essay_id"), F.col("text").alias("essay"),
                                     F.col("score").alias("domain1_score"))
    return delimited.csv_round_trip(e, scratch_path(spark, "essay-csv"))


@query("stage_table", f"WITH {E} SELECT id, topic, score, word_count FROM essays")
def q_stage_table(spark, sf_dir):
    e = essays(spark, sf_dir).select("id", "topic", "score", "word_count")
    return staging.stage(e, "essays", partition_by=None)


@query("project_columns", "SELECT doc_id, text, n_chars FROM documents")
def q_project(spark, sf_dir):
    return R.project(load(spark, sf_dir, "documents"), ["doc_id", "text", "n_chars"])


@query("rename_columns", "SELECT doc_id AS essay_id, text, lang AS topic, source, n_chars FROM documents")
def q_rename(spark, sf_dir):
    return R.rename(load(spark, sf_dir, "documents"), {"doc_id": "essay_id", "lang": "topic"})


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def q_drop(spark, sf_dir):
    return R.drop_strict(load(spark, sf_dir, "documents"), ["text", "n_chars"])


@query("cast_columns", f"""WITH {E} SELECT id, CAST(score AS DOUBLE) AS score,
       CAST(trunc(word_count::DOUBLE / 3) AS INTEGER) AS third, CAST(round_even(word_count::DOUBLE / 2, 0) AS INTEGER) AS half
FROM essays""")
def q_cast(spark, sf_dir):
    e = essays(spark, sf_dir).select("id", "score", (F.col("word_count").cast("double") / 3).alias("third"),
                                     (F.col("word_count").cast("double") / 2).alias("half"))
    return R.cast_scores(e, "score", rating="third", prediction="half")


@query("filter_topic", f"WITH {E} SELECT id, topic, score FROM essays WHERE topic = 'en'")
def q_filter_topic(spark, sf_dir):
    return R.filter_equals(essays(spark, sf_dir).select("id", "topic", "score"), "topic", "en")


@query("filter_score_range", f"WITH {E} SELECT id, score FROM essays WHERE score BETWEEN 1 AND 10")
def q_filter_score_range(spark, sf_dir):
    return R.filter_score_range(essays(spark, sf_dir).select("id", "score"))


@query("preview_rows", f"WITH {E} SELECT id, topic, score FROM essays ORDER BY id LIMIT 5")
def q_preview(spark, sf_dir):
    return R.preview(essays(spark, sf_dir).select("id", "topic", "score"), 5)


@query("sample_rows", f"WITH {E} SELECT id, score FROM essays ORDER BY md5(CAST(id AS VARCHAR) || ':26'), id LIMIT 7")
def q_sample(spark, sf_dir):
    return R.sample_n(essays(spark, sf_dir).select("id", "score"), 7, 26)


@query("point_lookup", f"WITH {E} SELECT id, text, score FROM essays WHERE id = 7")
def q_lookup(spark, sf_dir):
    return R.lookup(essays(spark, sf_dir).select("id", "text", "score"), "id", 7)


@query("table_shape", "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM documents")
def q_shape(spark, sf_dir):
    return R.shape(load(spark, sf_dir, "documents"))
