"""Feature selection, split and scaling queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorewright.functions import fixed
from scorewright.operators import selection as SEL, splits, textfeat
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.plans.text_q import FEATURES_SQL
from scorewright.plans.vocab_q import assembled
from scorewright.sources import essays, staging

E = S.ESSAYS
PRED = textfeat.PREDICTORS
SELECTED = fixed.SELECTION_FEATURES
CORR_COLS = PRED + ["target_score"]


def _features(spark, sf_dir):
    return textfeat.essay_features(essays(spark, sf_dir))


def _corr_sql(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, xb = f"CASE WHEN {both} THEN {a}::DOUBLE END", f"CASE WHEN {both} THEN {b}::DOUBLE END"
    return f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"


CHI_SQL = f"""{FEATURES_SQL},
bc AS (SELECT target_score, count(*) AS nc, {', '.join(f'sum({p}::DOUBLE) AS {p}' for p in SELECTED)} FROM features GROUP BY target_score),
lng AS (SELECT * FROM bc UNPIVOT INCLUDE NULLS (observed FOR feature IN ({', '.join(SELECTED)}))),
t AS (SELECT *, sum(observed) OVER (PARTITION BY feature) AS total, sum(nc) OVER (PARTITION BY feature) AS n FROM lng),
chi AS (SELECT feature, sum((observed - nc / n * total) * (observed - nc / n * total) / nullif(nc / n * total, 0)) AS chi2
        FROM t GROUP BY feature)"""


@query("chi2_scores", f"{CHI_SQL} SELECT feature, round(chi2, 6) AS chi2 FROM chi")
def q_chi2(spark, sf_dir):
    return rounded(SEL.chi2_scores(_features(spark, sf_dir), SELECTED, "target_score"))


@query("top_features", f"{CHI_SQL} SELECT feature, round(chi2, 6) AS chi2 FROM chi WHERE chi2 IS NOT NULL ORDER BY chi2 DESC, feature LIMIT 10")
def q_top_features(spark, sf_dir):
    return rounded(SEL.top_features(SEL.chi2_scores(_features(spark, sf_dir), SELECTED, "target_score"), "chi2", 10))


CORR_SQL = f"""{FEATURES_SQL},
agg AS (SELECT {', '.join(f'{_corr_sql(a, b)} AS c_{i}_{j}' for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS) if j >= i)} FROM features),
u AS (SELECT * FROM agg UNPIVOT INCLUDE NULLS (corr FOR name IN ({', '.join(f'c_{i}_{j}' for i in range(len(CORR_COLS)) for j in range(len(CORR_COLS)) if j >= i)}))),
p AS (SELECT CAST(split_part(name, '_', 2) AS BIGINT) AS i, CAST(split_part(name, '_', 3) AS BIGINT) AS j, corr FROM u),
m AS (SELECT i, j, corr FROM p UNION ALL SELECT j, i, corr FROM p WHERE i <> j),
names(idx, fname) AS (VALUES {', '.join(f'({i}, {S.q(c)})' for i, c in enumerate(CORR_COLS))}),
cm AS (SELECT na.fname AS feature_a, nb.fname AS feature_b, m.i, m.j, round(m.corr, 6) AS corr
       FROM m JOIN names na ON na.idx = m.i JOIN names nb ON nb.idx = m.j)"""


@query("correlation_matrix", f"{CORR_SQL} SELECT * FROM cm")
def q_corr(spark, sf_dir):
    return rounded(SEL.correlation_matrix(_features(spark, sf_dir), CORR_COLS, complete=True))


@query("correlation_lower_triangle", f"{CORR_SQL} SELECT * FROM cm WHERE i > j AND i < {len(PRED)}")
def q_corr_lower(spark, sf_dir):
    return rounded(SEL.lower_triangle(SEL.correlation_matrix(_features(spark, sf_dir), PRED, complete=True)))


ZV_SQL = f"""{FEATURES_SQL},
sd AS (SELECT topic, {', '.join(f'stddev_pop({p}::DOUBLE) AS {p}' for p in SELECTED)} FROM features GROUP BY topic),
zv AS (SELECT topic, feature, std, coalesce(std <> 0, false) AS kept
       FROM sd UNPIVOT INCLUDE NULLS (std FOR feature IN ({', '.join(SELECTED)})))"""


@query("zero_variance_filter", f"{ZV_SQL} SELECT topic, feature, round(std, 6) AS std, kept FROM zv")
def q_zero_variance(spark, sf_dir):
    return rounded(SEL.zero_variance(_features(spark, sf_dir), SELECTED))


FR_SQL = f"""{ZV_SQL},
fr0 AS (SELECT topic, count(*) AS n, {', '.join(f'{_corr_sql(p, "target_score")} AS {p}' for p in SELECTED)} FROM features GROUP BY topic),
fr AS (SELECT topic, feature, n, r,
              CASE WHEN r IS NULL THEN NULL WHEN least(greatest(r, -1.0), 1.0) ^ 2 >= 1 THEN 'inf'::DOUBLE
                   ELSE least(greatest(r, -1.0), 1.0) ^ 2 / (1 - least(greatest(r, -1.0), 1.0) ^ 2) * (n - 2) END AS f
       FROM fr0 UNPIVOT INCLUDE NULLS (r FOR feature IN ({', '.join(SELECTED)})))"""


@query("f_regression_scores", f"{FR_SQL} SELECT topic, feature, n, round(r, 6) AS r, round(f, 6) AS f FROM fr")
def q_f_regression(spark, sf_dir):
    return rounded(SEL.f_regression(_features(spark, sf_dir), SELECTED, "target_score"))


@query("select_k_best_by_topic", f"""{FR_SQL}
SELECT topic, feature, round(f, 6) AS f, rank FROM (
  SELECT fr.topic, fr.feature, fr.f, CAST(row_number() OVER (PARTITION BY fr.topic ORDER BY round(fr.f, 6) DESC NULLS LAST, fr.feature) AS BIGINT) AS rank
  FROM fr JOIN zv ON fr.topic = zv.topic AND fr.feature = zv.feature WHERE zv.kept) WHERE rank <= 10""")
def q_select_k_best(spark, sf_dir):
    return rounded(SEL.select_k_best_by_group(_features(spark, sf_dir), SELECTED, "target_score", "topic", 10))


@query("train_test_split", f"WITH {E} SELECT id, topic, CASE WHEN {S.split_hash('id', 26)} % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM essays")
def q_train_test(spark, sf_dir):
    return splits.train_test(essays(spark, sf_dir).select("id", "topic"), "id", 26)


@query("train_val_test_split", f"""WITH {E} SELECT id, topic, CASE WHEN {S.split_hash('id', 42)} % 100 < 70 THEN 'train'
  WHEN {S.split_hash('id', 42)} % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM essays""")
def q_train_val_test(spark, sf_dir):
    return splits.train_val_test(essays(spark, sf_dir).select("id", "topic"), "id", 42)


@query("kfold_assign", f"""WITH {E} SELECT id, topic, CAST(ntile(5) OVER (PARTITION BY topic ORDER BY id) - 1 AS INTEGER) AS fold FROM essays""")
def q_kfold(spark, sf_dir):
    return splits.kfold(essays(spark, sf_dir).select("id", "topic"), 5, "topic", "id")


@query("standard_scale", f"""{FEATURES_SQL},
st AS (SELECT topic, {', '.join(f'avg({c}::DOUBLE) AS m_{c}, stddev_pop({c}::DOUBLE) AS s_{c}' for c in PRED)} FROM features GROUP BY topic)
SELECT f.id, f.topic, {', '.join(f'round(coalesce((f.{c}::DOUBLE - st.m_{c}) / nullif(st.s_{c}, 0), 0.0), 6) AS {c}' for c in PRED)}
FROM features f JOIN st ON f.topic = st.topic""")
def q_standard_scale(spark, sf_dir):
    f = staging.stage(_features(spark, sf_dir).select("id", "topic", *PRED), "scale-input")
    return rounded(SEL.standard_scale(f, PRED, "topic"))


ASSEMBLED_SQL = f"""{FEATURES_SQL},
lem AS (SELECT id, array_to_string(list_transform(tokens, lambda x: {S.lemma('lower(x)')}), ' ') AS l_essay FROM ann),
vterms AS (SELECT id, unnest({S.remove_stopwords(S.vocabulary_terms('l_essay'))}) AS term FROM lem),
vtf AS (SELECT id, term, count(*) AS tf FROM vterms GROUP BY id, term),
vstats AS (SELECT term, count(*) AS df, sum(tf) AS n FROM vtf GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS nd FROM essays),
vocab AS (SELECT term, df, row_number() OVER (ORDER BY n DESC, term) - 1 AS ix FROM vstats, nd
          WHERE df >= 3 AND df <= 0.2 * nd.nd ORDER BY n DESC, term LIMIT 2000),
w AS (SELECT vtf.id, v.ix, vtf.tf * (ln((1 + nd.nd) / (1 + v.df)) + 1) AS w FROM vtf JOIN vocab v USING (term), nd),
nw AS (SELECT id, ix, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
tv AS (SELECT id, string_agg(ix::VARCHAR, ',' ORDER BY ix) AS indices, list(round(w, 6) ORDER BY ix) AS tfidf FROM nw GROUP BY id)"""


@query("assemble_features", f"""{ASSEMBLED_SQL}
SELECT f.* REPLACE (round(similarity, 6) AS similarity), coalesce(tv.indices, '') AS indices,
       CAST(coalesce(len(tv.tfidf), 0) AS BIGINT) AS n_terms, coalesce(round(list_sum(tv.tfidf), 4), 0.0) AS tfidf_sum,
       coalesce(round(list_max(tv.tfidf), 6), 0.0) AS tfidf_max
FROM features f LEFT JOIN tv ON f.id = tv.id""")
def q_assemble(spark, sf_dir):
    """The assembled row (predictors, TF-IDF vector, topic, score); the vector is shown by its indices, sum and maximum."""
    rows = assembled(essays(spark, sf_dir)).withColumn("v", F.col("tfidf"))
    values = F.transform(vector_to_array("v"), lambda x: F.round(x, 6))
    rows = rows.select("id", "topic", "target_score", *PRED, values.alias("values"))
    some = F.filter(F.transform("values", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select(
        "id", "topic", "target_score", *PRED, F.array_join(F.transform(some, lambda i: i.cast("string")), ",").alias("indices"),
        F.size(some).cast("bigint").alias("n_terms"), F.round(total, 4).alias("tfidf_sum"),
        F.coalesce(F.array_max("values"), F.lit(0.0)).alias("tfidf_max")))
