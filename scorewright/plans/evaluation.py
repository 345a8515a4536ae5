"""Evaluation queries: kappa family, error metrics, the per-topic flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import metrics, scoring
from scorewright.plans.catalog import query, rounded
from scorewright.plans.sql import ESSAYS, split_hash
from scorewright.sources import essays, load

# lineitem as a large table of rating pairs: a = line number (1..7), b = quantity mod 7 + 1
RATINGS_SQL = """ratings AS (
  SELECT l_returnflag AS grp, CAST(l_linenumber AS BIGINT) AS rater_a,
         CAST(1 + CAST(l_quantity AS INTEGER) % 7 AS BIGINT) AS rater_b
  FROM lineitem)"""


def ratings(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("grp"),
                     F.col("l_linenumber").cast("bigint").alias("rater_a"),
                     (F.lit(1) + F.col("l_quantity").cast("int") % 7).cast("bigint").alias("rater_b"))


EVAL_SQL = f"""WITH {ESSAYS},
split AS (SELECT *, CASE WHEN split_hash % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM essays),
coef AS (
  SELECT topic, count(*) AS weight,
         regr_slope(CASE WHEN split = 'train' THEN score::DOUBLE END, CASE WHEN split = 'train' THEN word_count::DOUBLE END) AS slope,
         regr_intercept(CASE WHEN split = 'train' THEN score::DOUBLE END, CASE WHEN split = 'train' THEN word_count::DOUBLE END) AS intercept
  FROM split GROUP BY topic),
pred AS (
  SELECT s.topic, CAST(trunc(c.intercept + c.slope * s.word_count::DOUBLE) AS BIGINT) AS a, CAST(s.score AS BIGINT) AS b
  FROM split s JOIN coef c ON s.topic = c.topic WHERE s.split = 'test'),
kap AS (
  SELECT topic, count(*) AS n_test,
         1 - (count(*)::DOUBLE * sum((a - b) * (a - b))::DOUBLE)
           / nullif(count(*)::DOUBLE * (sum(a * a)::DOUBLE + sum(b * b)::DOUBLE) - 2.0 * sum(a)::DOUBLE * sum(b)::DOUBLE, 0) AS kappa
  FROM pred GROUP BY topic)"""


@query("evaluate_by_topic", f"""{EVAL_SQL}
SELECT c.topic, c.weight, round(c.slope, 6) AS slope, round(c.intercept, 6) AS intercept, k.n_test, round(k.kappa, 6) AS kappa
FROM coef c LEFT JOIN kap k ON c.topic = k.topic""")
def q_evaluate_by_topic(spark, sf_dir):
    return rounded(scoring.evaluate_ols_by_topic(essays(spark, sf_dir)))


@query("mean_quadratic_weighted_kappa", f"""{EVAL_SQL}
SELECT round(tanh(sum(c.weight * atanh(least(greatest(k.kappa, -0.999), 0.999))) / sum(c.weight)), 6) AS mean_kappa,
       count(*) AS n_groups
FROM coef c JOIN kap k ON c.topic = k.topic WHERE k.kappa IS NOT NULL""")
def q_mean_qwk(spark, sf_dir):
    per_topic = scoring.evaluate_ols_by_topic(essays(spark, sf_dir))
    return rounded(metrics.mean_quadratic_weighted_kappa(per_topic, "kappa", "weight"))


QWK_SQL = """1 - (count(*)::DOUBLE * sum((a - b) * (a - b))::DOUBLE)
      / nullif(count(*)::DOUBLE * (sum(a * a)::DOUBLE + sum(b * b)::DOUBLE) - 2.0 * sum(a)::DOUBLE * sum(b)::DOUBLE, 0)"""


@query("quadratic_weighted_kappa", f"""WITH {RATINGS_SQL}
SELECT grp, count(*) AS n, round({QWK_SQL}, 6) AS kappa
FROM (SELECT grp, rater_a AS a, rater_b AS b FROM ratings) GROUP BY grp""")
def q_qwk(spark, sf_dir):
    return rounded(metrics.quadratic_weighted_kappa(ratings(spark, sf_dir), "rater_a", "rater_b", "grp"))


# second rater with skipped labels (odd values up to 13): the label-rank kappa differs
GAP_SQL = """gap AS (SELECT grp, rater_a, 1 + (rater_b - 1) * 2 AS rater_b FROM ratings)"""


def gap_ratings(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return r.withColumn("rater_b", F.lit(1) + (F.col("rater_b") - 1) * 2)


@query("cohen_kappa_quadratic", f"""WITH {RATINGS_SQL}, {GAP_SQL},
labels AS (SELECT grp, label, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY label) - 1 AS BIGINT) AS r
           FROM (SELECT grp, rater_a AS label FROM gap UNION SELECT grp, rater_b FROM gap)),
ranked AS (SELECT g.grp, la.r AS a, lb.r AS b FROM gap g
           JOIN labels la ON la.grp = g.grp AND la.label = g.rater_a
           JOIN labels lb ON lb.grp = g.grp AND lb.label = g.rater_b)
SELECT grp, count(*) AS n, round({QWK_SQL}, 6) AS kappa FROM ranked GROUP BY grp""")
def q_cohen(spark, sf_dir):
    return rounded(metrics.cohen_kappa_quadratic(gap_ratings(spark, sf_dir), "rater_a", "rater_b", "grp"))


@query("value_kappa_with_gaps", f"""WITH {RATINGS_SQL}, {GAP_SQL}
SELECT grp, count(*) AS n, round({QWK_SQL}, 6) AS kappa
FROM (SELECT grp, rater_a AS a, rater_b AS b FROM gap) GROUP BY grp""")
def q_value_kappa_gaps(spark, sf_dir):
    return rounded(metrics.quadratic_weighted_kappa(gap_ratings(spark, sf_dir), "rater_a", "rater_b", "grp"))


@query("confusion_matrix", f"""WITH {RATINGS_SQL},
rng AS (SELECT least(min(rater_a), min(rater_b)) AS lo, greatest(max(rater_a), max(rater_b)) AS hi FROM ratings),
grid AS (SELECT a.v AS rater_a, b.v AS rater_b FROM rng, range(rng.lo, rng.hi + 1) a(v), range(rng.lo, rng.hi + 1) b(v)),
cnt AS (SELECT rater_a, rater_b, count(*) AS n FROM ratings GROUP BY 1, 2)
SELECT g.rater_a, g.rater_b, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN cnt c USING (rater_a, rater_b)""")
def q_confusion(spark, sf_dir):
    return metrics.confusion_matrix(ratings(spark, sf_dir), "rater_a", "rater_b")


@query("rating_histogram", f"""WITH {RATINGS_SQL}, {GAP_SQL},
rng AS (SELECT least(min(rater_a), min(rater_b)) AS lo, greatest(max(rater_a), max(rater_b)) AS hi FROM gap),
grid AS (SELECT v AS rating FROM rng, range(rng.lo, rng.hi + 1) t(v)),
cnt AS (SELECT rater_b AS rating, count(*) AS n FROM gap GROUP BY 1)
SELECT g.rating, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN cnt c USING (rating)""")
def q_hist(spark, sf_dir):
    return metrics.rating_histogram(gap_ratings(spark, sf_dir), "rater_b", "rater_a")


@query("label_union", f"""WITH {RATINGS_SQL}, {GAP_SQL}
SELECT rater_a AS label FROM gap UNION SELECT rater_b FROM gap""")
def q_label_union(spark, sf_dir):
    g = gap_ratings(spark, sf_dir)
    return g.select(F.col("rater_a").alias("label")).union(g.select("rater_b")).distinct()


@query("rater_agreement", f"""WITH {ESSAYS}
SELECT topic, count(*) AS n, round({QWK_SQL}, 6) AS kappa
FROM (SELECT topic, CAST(rater1 AS BIGINT) AS a, CAST(rater2 AS BIGINT) AS b FROM essays) GROUP BY topic""")
def q_rater_agreement(spark, sf_dir):
    return rounded(metrics.quadratic_weighted_kappa(essays(spark, sf_dir), "rater1", "rater2", "topic"))


PRED3_SQL = f"""WITH {ESSAYS},
split AS (SELECT *, CASE WHEN {split_hash('id', 42)} % 100 < 70 THEN 'train'
                         WHEN {split_hash('id', 42)} % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM essays),
coef AS (SELECT topic,
         regr_slope(CASE WHEN split = 'train' THEN score::DOUBLE END, CASE WHEN split = 'train' THEN word_count::DOUBLE END) AS slope,
         regr_intercept(CASE WHEN split = 'train' THEN score::DOUBLE END, CASE WHEN split = 'train' THEN word_count::DOUBLE END) AS intercept
         FROM split GROUP BY topic),
pred AS (SELECT s.id, s.split, s.score AS y_true, c.intercept + c.slope * s.word_count::DOUBLE AS y_pred
         FROM split s JOIN coef c ON s.topic = c.topic)"""


def predictions_3way(spark, sf_dir):
    from scorewright.operators import splits
    from scorewright.sources.staging import stage
    e = splits.train_val_test(essays(spark, sf_dir), "id", seed=42).select("id", "topic", "word_count", "score", "split")
    e = stage(e, "ols-3way-input")  # fit and scoring read one narrow pass over the text
    coef = scoring.ols_by_topic(e, "word_count")
    preds = scoring.predict_ols(e, coef, "word_count").select(
        "id", "split", F.col("score").alias("y_true"), "y_pred")
    return stage(preds, "ols-predictions")  # errors and kappa read them once each


@query("regression_metrics", f"""{PRED3_SQL}
SELECT split, count(*) AS n, round(avg((y_pred - y_true) ^ 2), 6) AS mse, round(sqrt(avg((y_pred - y_true) ^ 2)), 6) AS rmse,
       round(avg(abs(y_pred - y_true)), 6) AS mae
FROM pred GROUP BY split""")
def q_regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(predictions_3way(spark, sf_dir), "y_true", "y_pred", "split"))


@query("metrics_by_split", f"""{PRED3_SQL},
p AS (SELECT split, CAST(y_true AS BIGINT) AS y_true, CAST(round_even(y_pred, 0) AS BIGINT) AS y_round, y_pred FROM pred),
labels AS (SELECT split, label, CAST(dense_rank() OVER (PARTITION BY split ORDER BY label) - 1 AS BIGINT) AS r
           FROM (SELECT split, y_true AS label FROM p UNION SELECT split, y_round FROM p)),
ranked AS (SELECT p.split, la.r AS a, lb.r AS b FROM p
           JOIN labels la ON la.split = p.split AND la.label = p.y_true
           JOIN labels lb ON lb.split = p.split AND lb.label = p.y_round),
kap AS (SELECT split, {QWK_SQL} AS kappa FROM ranked GROUP BY split),
err AS (SELECT split, count(*) AS n, avg((y_pred - y_true) ^ 2) AS mse, sqrt(avg((y_pred - y_true) ^ 2)) AS rmse,
               avg(abs(y_pred - y_true)) AS mae FROM p GROUP BY split)
SELECT e.split, e.n, round(e.mse, 6) AS mse, round(e.rmse, 6) AS rmse, round(e.mae, 6) AS mae, round(k.kappa, 6) AS kappa
FROM err e LEFT JOIN kap k USING (split)""")
def q_metrics_by_split(spark, sf_dir):
    return rounded(metrics.metrics_by_split(predictions_3way(spark, sf_dir), "y_true", "y_pred"))
