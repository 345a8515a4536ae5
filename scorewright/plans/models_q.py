"""Model queries.

Models carry the reference's parameter values.  What a forest, a support vector machine or a
topic model returns has no SQL form, so these queries return what must hold of it, row by
row, next to counts that DuckDB computes from the inputs: predictions inside the range of the
training scores, one best combination of a full grid, an ordered topic, an unchanged reload.
Least squares and elastic nets are exact (``operators.gram``) and checked by value.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewright.functions import fixed, text as T
from scorewright.operators import boosting, embeddings, gram, metrics, models as M, splits, svm, textfeat, topics, trees, vocab as V
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.plans.selection_q import ZV_SQL
from scorewright.plans.text_q import SENT_SQL
from scorewright.plans.vocab_q import TF_SQL, assembled
from scorewright.session import scratch_path
from scorewright.sources import essays, staging

PRED = textfeat.PREDICTORS
SPLIT2 = f"""WITH {S.ESSAYS},
s AS (SELECT *, CASE WHEN {S.split_hash('id', 26)} % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM essays)"""


def _model_frame(spark, sf_dir):
    """Essay features with the 70/30 hash split (seed 26), staged once per call: iterative fits then read a
    narrow Parquet table, and a lost executor recomputes from it, not from the texts."""
    f = textfeat.essay_features(essays(spark, sf_dir))
    return staging.stage(splits.train_test(f, "id", 26), "model-frame")


@query("fit_simple_regression", f"""{SPLIT2}
SELECT topic, round(regr_slope(score::DOUBLE, word_count::DOUBLE), 6) AS slope,
       round(regr_intercept(score::DOUBLE, word_count::DOUBLE), 6) AS intercept
FROM s WHERE split = 'train' GROUP BY topic""")
def q_fit_simple_regression(spark, sf_dir):
    e = splits.train_test(essays(spark, sf_dir).select("id", "topic", "word_count", "score"), "id", 26)
    fits = gram.elastic_nets(e.filter(F.col("split") == "train"), ["word_count"], "score", ["topic"], 0.0, 0.0)
    return rounded(fits.select("topic", F.col("coefficients")[0].alias("slope"), "intercept"))


@query("fit_linear_regression", f"""{SPLIT2}
SELECT topic, count(*) AS n_train, round(avg(score::DOUBLE), 6) AS mean_score, round(avg(score::DOUBLE), 6) AS mean_prediction,
       true AS orthogonal FROM s WHERE split = 'train' GROUP BY topic""")
def q_fit_linear_regression(spark, sf_dir):
    """Least squares on all 30 predictors: residuals average to zero and are orthogonal to every predictor.

    (Scaling the predictors first, as the reference does, changes no prediction.)"""
    train = _model_frame(spark, sf_dir).filter(F.col("split") == "train")
    fits = gram.elastic_nets(train, PRED, "target_score", ["topic"], 0.0, 0.0)
    p = gram.predict(train, fits, PRED, ["topic"])
    e = F.col("target_score") - F.col("prediction")
    dots = [F.abs(F.covar_pop(e, F.col(c).cast("double"))) / (1 + F.stddev_pop(F.col(c).cast("double"))) for c in PRED]
    return rounded(p.groupBy("topic").agg(
        F.count("*").alias("n_train"), F.avg("target_score").alias("mean_score"), F.avg("prediction").alias("mean_prediction"),
        (F.greatest(*dots) < 1e-6).alias("orthogonal")))


# the reference's elastic net: alpha 0.1, L1 share 0.01; one predictor has a closed form
EN_ALPHA, EN_RATIO = 0.1, 0.01


@query("fit_elastic_net", f"""{SPLIT2},
m AS (SELECT topic, avg(score::DOUBLE) AS my, avg(word_count::DOUBLE) AS mx, covar_pop(score::DOUBLE, word_count::DOUBLE) AS c,
             var_pop(word_count::DOUBLE) AS v FROM s WHERE split = 'train' GROUP BY topic),
w AS (SELECT *, sign(c) * greatest(abs(c) - {EN_ALPHA} * {EN_RATIO}, 0) / (v + {EN_ALPHA} * (1 - {EN_RATIO})) AS w FROM m)
SELECT topic, round(w, 6) AS coefficient, round(my - w * mx, 6) AS intercept FROM w""")
def q_fit_elastic_net(spark, sf_dir):
    e = splits.train_test(essays(spark, sf_dir).select("id", "topic", "word_count", "score"), "id", 26)
    fits = gram.elastic_nets(e.filter(F.col("split") == "train"), ["word_count"], "score", ["topic"], EN_ALPHA, EN_RATIO)
    return rounded(fits.select("topic", F.col("coefficients")[0].alias("coefficient"), "intercept"))


@query("elastic_net_conditions", f"""{SPLIT2}
SELECT topic, f.predictor, n_train, true AS optimal FROM (SELECT topic, count(*) AS n_train FROM s WHERE split = 'train' GROUP BY topic),
(VALUES {', '.join(f"('{c}')" for c in PRED)}) f(predictor)""")
def q_elastic_net_conditions(spark, sf_dir):
    """The elastic net on all 30 predictors: whether each coefficient satisfies its optimality condition.

    With g the mean product of the centred predictor and the residual: g = a1 sign(w) + a2 w where w is not 0,
    and |g| <= a1 where it is."""
    train = _model_frame(spark, sf_dir).filter(F.col("split") == "train")
    fits = staging.stage(gram.elastic_nets(train, PRED, "target_score", ["topic"], EN_ALPHA, EN_RATIO), "elastic-nets")
    e = F.col("target_score") - F.col("prediction")
    found = gram.predict(train, fits, PRED, ["topic"]).groupBy("topic").agg(
        F.count("*").alias("n_train"), F.array(*(F.covar_pop(F.col(c).cast("double"), e) for c in PRED)).alias("g"),
        F.array(*(F.stddev_pop(F.col(c).cast("double")) for c in PRED)).alias("sd"))
    each = found.join(fits.select("topic", "coefficients"), "topic").select("topic", "n_train", F.posexplode(F.arrays_zip(
        F.array(*map(F.lit, PRED)).alias("predictor"), F.col("g"), F.col("sd"), F.col("coefficients").alias("w"))).alias("i", "c"))
    g, w, a1, a2 = F.col("c.g"), F.col("c.w"), EN_ALPHA * EN_RATIO, EN_ALPHA * (1 - EN_RATIO)
    off = F.when(w == 0, F.greatest(F.abs(g) - a1, F.lit(0.0))).otherwise(F.abs(g - a1 * F.signum(w) - a2 * w))
    return each.select("topic", F.col("c.predictor").alias("predictor"), "n_train",
                       (off < 1e-6 * (1 + F.col("c.sd"))).alias("optimal"))


RANGE_SQL = f"""{SPLIT2}
SELECT id, topic, true AS valid FROM s WHERE split = 'test'"""


def _within_training_range(df, p):
    """Mean-of-leaves and class predictions never leave their topic's training scores."""
    span = staging.stage(df.filter(F.col("split") == "train").groupBy("topic").agg(
        F.min("target_score").alias("lo"), F.max("target_score").alias("hi")), "score-ranges")
    return p.join(span, "topic").select("id", "topic", F.col("prediction").between(
        F.col("lo") - 1e-9, F.col("hi") + 1e-9).alias("valid"))


@query("fit_random_forest", RANGE_SQL)
def q_fit_random_forest(spark, sf_dir):
    df = _model_frame(spark, sf_dir)
    return _within_training_range(df, M.predict_by_topic(df, PRED, "random_forest"))


@query("fit_linear_svc", f"""{SPLIT2},
c AS (SELECT topic, count(DISTINCT score) AS k FROM s WHERE split = 'train' GROUP BY topic)
SELECT id, topic, true AS valid, CASE WHEN k > 1 THEN k ELSE 0 END AS optimal FROM s JOIN c USING (topic) WHERE split = 'test'""")
def q_fit_linear_svc(spark, sf_dir):
    """One-vs-rest machines with the reference's C: predictions are training classes of the topic, and each
    class's machine satisfies the optimality conditions (all of them counted)."""
    df = _model_frame(spark, sf_dir)
    train = df.filter(F.col("split") == "train")
    scale, weights, slope = svm.fit(train, PRED, "target_score", "topic")
    p = svm.predict(df.filter(F.col("split") == "test"), PRED, "topic", scale, weights)
    n = {}
    for (topic, _), value in slope.items():  # largest entry of each problem's gradient
        n[topic] = n.get(topic, 0) + int(value < 1e-3)
    good = F.create_map(*[F.lit(x) for topic, k in n.items() for x in (topic, k)]) if n else F.create_map(F.lit(""), F.lit(0))
    seen = train.select("topic", F.col("target_score").alias("prediction")).distinct().withColumn("seen", F.lit(True))
    return p.join(staging.stage(seen, "training-classes"), ["topic", "prediction"], "left").select(
        "id", "topic", F.coalesce("seen", F.lit(False)).alias("valid"),
        F.coalesce(good[F.col("topic")], F.lit(0)).cast("long").alias("optimal"))


@query("model_leaderboard", f"""{SPLIT2}
SELECT m AS model, count(DISTINCT topic) AS n_groups, true AS in_range
FROM s, (VALUES {', '.join(f"('{m}')" for m in M.MODEL_NAMES)}) v(m) GROUP BY m""")
def q_leaderboard(spark, sf_dir):
    df = _model_frame(spark, sf_dir)
    per = None
    for name in M.MODEL_NAMES:
        kw = {"alpha": EN_ALPHA, "l1_ratio": EN_RATIO} if name == "elastic_net" else {}
        r = M.evaluate_by_topic(df, PRED, name, **kw)
        per = r if per is None else per.unionByName(r)
    board = M.leaderboard(per)
    return board.select("model", "n_groups", (F.col("mean_kappa").between(-1, 1) & F.col("rank").between(1, 4)).alias("in_range"))


@query("tree_feature_importance", f"""{ZV_SQL},
c AS (SELECT feature, bool_and(std = 0) AS constant FROM (SELECT feature, stddev_pop(v::DOUBLE) AS std
      FROM (SELECT * FROM (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in fixed.SELECTION_FEATURES)} FROM features)
            UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(fixed.SELECTION_FEATURES)}))) GROUP BY feature) GROUP BY feature)
SELECT feature, constant, 1.0 AS total, true AS valid FROM c""")
def q_tree_importance(spark, sf_dir):
    """Importances of 100 extremely randomised trees over the 28 selection features: non-negative, one in all,
    none for a constant."""
    cols = fixed.SELECTION_FEATURES
    df = _model_frame(spark, sf_dir)
    imp = trees.fit(df, cols, "target_score").importances()
    std = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    rows = [(c, std[c] == 0, round(sum(imp), 6), v >= 0 and (std[c] > 0 or v == 0)) for c, v in zip(cols, imp)]
    return spark.createDataFrame(rows, "feature string, constant boolean, total double, valid boolean")


@query("extra_trees_roots", f"""{ZV_SQL},
names AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {j})" for j, c in enumerate(fixed.SELECTION_FEATURES))}) f(feature, j)),
u AS (SELECT target_score, j, coalesce(v, 0) AS v FROM (SELECT target_score, {', '.join(f'{c}::DOUBLE AS {c}' for c in fixed.SELECTION_FEATURES)}
      FROM features WHERE target_score IS NOT NULL) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(fixed.SELECTION_FEATURES)})) JOIN names USING (feature)),
r AS (SELECT j, min(v) AS lo, max(v) AS hi FROM u GROUP BY j HAVING min(v) < max(v)),
d AS (SELECT tree, j, lo, hi, md5('{trees.SEED}:' || tree || ':0:' || j) AS digest FROM r, range({trees.TREES}) t(tree)),
c AS (SELECT tree, j, lo + ('0x' || substr(digest, 25, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE * (hi - lo) AS cut FROM d
      QUALIFY row_number() OVER (PARTITION BY tree ORDER BY digest) <= {trees.TRIES}),
p AS (SELECT tree, j, cut, target_score, count(*) AS n, count(*) FILTER (v <= cut) AS l FROM c JOIN u USING (j) GROUP BY ALL),
g AS (SELECT tree, j, cut, sum(n)::BIGINT AS n, sum(l)::BIGINT AS n_left, sum(l * l)::DOUBLE / sum(l)::DOUBLE
             + sum((n - l) * (n - l))::DOUBLE / sum(n - l)::DOUBLE - sum(n * n)::DOUBLE / sum(n)::DOUBLE AS gain
      FROM p GROUP BY tree, j, cut HAVING sum(l) > 0 AND sum(n - l) > 0)
SELECT tree, feature, round(cut, 6) AS cut, round(gain, 6) AS gain, n, n_left FROM g JOIN names USING (j)
QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gain DESC, j) = 1""")
def q_extra_trees_roots(spark, sf_dir):
    """First split of each extremely randomised tree: feature, cut, fall of Gini impurity, rows on the left."""
    cols = fixed.SELECTION_FEATURES
    model = trees.fit(_model_frame(spark, sf_dir), cols, "target_score", depth=1)
    rows = [(tree, cols[f], cut, gain, n, left) for tree, _, f, cut, gain, n, left in model.splits]
    return rounded(spark.createDataFrame(rows, "tree long, feature string, cut double, gain double, n long, n_left long"))


@query("grid_search_cv", f"""WITH {S.ESSAYS}, g AS (SELECT DISTINCT topic FROM essays)
SELECT topic, 12 AS n_combinations, 1 AS n_best, true AS best_is_highest, true AS kappa_in_range FROM g""")
def q_grid_search(spark, sf_dir):
    """Elastic nets on predictors and TF-IDF of the lemmatised essays: 12 combinations, 5 folds, refit, kappa."""
    df = M.assembler(["tfidf", *PRED]).transform(assembled(essays(spark, sf_dir)))
    df = splits.train_test(df.select("id", "topic", "target_score", vector_to_array("features").alias("x")), "id", 26)
    df = staging.stage(df, "tfidf-frame")
    train = splits.kfold(df.filter(F.col("split") == "train"), 5, "topic", "id")
    found = staging.stage(gram.grid_search(train, "x", "target_score", "topic", "fold", fixed.ALPHAS, fixed.L1_RATIOS),
                          "grid-found")
    w = found.filter("best").select("topic", "coefficients", "intercept")
    dot = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = df.filter(F.col("split") == "test").join(staging.stage(w, "grid-models"), "topic").select(
        "topic", (dot + F.col("intercept")).cast("int").alias("a"), F.col("target_score").cast("int").alias("b"))
    kappa = metrics.quadratic_weighted_kappa(p, "a", "b", "topic")
    per = found.groupBy("topic").agg(
        F.count("*").cast("int").alias("n_combinations"), F.sum(F.col("best").cast("int")).cast("int").alias("n_best"),
        (F.max(F.when(F.col("best"), F.col("cv_r2"))) == F.max("cv_r2")).alias("best_is_highest"))
    return per.join(kappa, "topic", "left").select(
        "topic", "n_combinations", "n_best", "best_is_highest",
        F.coalesce(F.col("kappa").between(-1, 1), F.lit(True)).alias("kappa_in_range"))


# ---- word vectors and essay vectors -----------------------------------------

DIMS, MIN_COUNT, EPOCHS = embeddings.DIMS, embeddings.MIN_COUNT, embeddings.EPOCHS


def _sentences(spark, sf_dir):
    """(id, sent_no, words): word lists of the sentences, stop words out (they never reach the vectors)."""
    e = essays(spark, sf_dir)
    marked = F.regexp_replace(T.strip(F.col("text")), r"([.!?])\s+", "$1\u0001")
    s = e.select("id", F.posexplode(F.split(marked, "\u0001", -1)).alias("sent_no", "sentence"))
    words = T.remove_stopwords(T.normalized_words(F.col("sentence")))
    return s.select("id", "sent_no", words.alias("words")).filter(F.size("words") > 0)


def _word_model(spark, sf_dir):
    """(word, n, kept, vector), trained once for the same sentences and then read from the shared folder."""
    sentences = staging.stage(_sentences(spark, sf_dir), "sentences")
    return staging.remembered(spark, "word-vectors", sentences, lambda: embeddings.fit(sentences))


def _vectors(spark, sf_dir):
    return _word_model(spark, sf_dir).select("word", F.col("vector").cast("array<double>").alias("vector"))


WORDS_SQL = f"""{SENT_SQL},
sw AS (SELECT id, sent_no, unnest(ws) AS word, unnest(range(len(ws))) AS place
       FROM (SELECT id, sent_no, {S.remove_stopwords(S.normalized_words('sentence'))} AS ws FROM x)),
wc AS (SELECT word, count(*) AS n FROM sw GROUP BY word HAVING count(*) >= {MIN_COUNT})"""
_KEPT = [f"k{e}" for e in range(EPOCHS)]
_DRAWN_SQL = ", ".join(f"(('0x' || substr(h, {1 + embeddings.DIGITS * e}, {embeddings.DIGITS}))::BIGINT / 16777216.0::DOUBLE < share)::BIGINT AS k{e}"
                       for e in range(EPOCHS))


@query("train_word_vectors", f"""{WORDS_SQL},
t AS (SELECT {embeddings.SAMPLE}::DOUBLE * sum(n)::DOUBLE AS t FROM wc),
p AS (SELECT word, n, least(1.0, (sqrt(n::DOUBLE / t) + 1) * t / n::DOUBLE) AS share FROM wc, t),
d AS (SELECT id, sent_no, word, n, share, md5(concat(id, ':', sent_no, ':', place)) AS h FROM sw JOIN p USING (word)),
k AS (SELECT id, sent_no, word, n, {_DRAWN_SQL} FROM d),
c AS (SELECT *, {', '.join(f"{k} = 1 AND sum({k}) OVER (PARTITION BY id, sent_no) > 1 AS near_{k}" for k in _KEPT)} FROM k)
SELECT word, any_value(n) AS n, CAST(sum({' + '.join(_KEPT)}) AS BIGINT) AS kept, CAST({DIMS} AS INTEGER) AS dims, true AS finite,
       bool_or({' OR '.join(f"near_{k}" for k in _KEPT)}) AS moved FROM c GROUP BY word""")
def q_train_word_vectors(spark, sf_dir):
    """Five epochs over all sentences: occurrences kept by subsampling, and whether training has moved the vector (it
    moves those of words that ever stand beside another)."""
    moved = F.exists(F.zip_with("vector", embeddings.start_vector(), lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    finite = F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < 1e3))
    return _word_model(spark, sf_dir).select("word", "n", "kept", F.size("vector").alias("dims"), finite.alias("finite"),
                                             moved.alias("moved"))


@query("export_word_vectors", f"{WORDS_SQL} SELECT word, CAST({DIMS} AS INTEGER) AS dims, true AS same FROM wc")
def q_export_word_vectors(spark, sf_dir):
    """Written as float32 and read again: every word with the vector it had."""
    vecs = _vectors(spark, sf_dir)
    read = staging.stage(vecs.select("word", F.col("vector").cast("array<float>").alias("vector")), "exported-vectors")
    close = F.forall(F.zip_with(F.col("a"), F.col("b"), lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return vecs.select("word", F.col("vector").alias("a")).join(read.withColumnRenamed("vector", "b"), "word", "full") \
        .select("word", F.size("b").alias("dims"), close.alias("same"))


ESSAY_SPLIT = f"""WITH {S.ESSAYS},
s AS (SELECT *, CASE WHEN {S.split_hash('id', 42)} % 100 < 70 THEN 'train'
                     WHEN {S.split_hash('id', 42)} % 100 < 85 THEN 'val' ELSE 'test' END AS split
      FROM essays WHERE score BETWEEN 1 AND 10)"""


def _essay_vectors(spark, sf_dir):
    vecs = _word_model(spark, sf_dir).select("word", "vector")  # as floats: half of what a copy per block would be as doubles
    e = splits.train_val_test(essays(spark, sf_dir), "id", 42)
    e = e.filter(F.col("score").between(1, 10))
    words = staging.stage(e.select("id", T.remove_stopwords(T.normalized_words(F.col("text"))).alias("words")), "essay-words")
    av = V.average_word_vectors(words, vecs, DIMS)
    return e.select("id", "split", "score").join(av, "id")


@query("essay_vectors", f"{ESSAY_SPLIT} SELECT id, split, score, CAST({DIMS} AS INTEGER) AS dims FROM s")
def q_essay_vectors(spark, sf_dir):
    return _essay_vectors(spark, sf_dir).select("id", "split", "score", F.size("vector").alias("dims"))


def _vector_frame(spark, sf_dir):
    ev = _essay_vectors(spark, sf_dir)
    return staging.stage(ev.select("id", "split", F.col("score").cast("double").alias("label"),
                                   array_to_vector("vector").alias("features")), "vector-frame")


@query("embedding_regression", f"{ESSAY_SPLIT} SELECT split, count(*) AS n, true AS consistent FROM s GROUP BY split")
def q_embedding_regression(spark, sf_dir):
    df = _vector_frame(spark, sf_dir)
    model = LinearRegression(regParam=0.01, maxIter=100).fit(df.filter(F.col("split") == "train"))
    p = model.transform(df).withColumn("y_pred", F.greatest(F.col("prediction"), F.lit(0.0)))
    m = metrics.metrics_by_split(p.withColumn("y_true", F.col("label").cast("int")), "y_true", "y_pred")
    close = F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-6
    return m.select("split", "n", (close & (F.col("mae") <= F.col("rmse") + 1e-9)
                                   & F.coalesce(F.col("kappa").between(-1, 1), F.lit(True))).alias("consistent"))


#: Most boosting rounds, and the reference's patience.
BOOSTS, PATIENCE = 40, 10


def _stopped(spark, sf_dir):
    df = _vector_frame(spark, sf_dir).filter(F.col("split") != "test")
    model = boosting.Boosting(df, depth=3, step=0.3)
    model.advance(BOOSTS, PATIENCE)
    return df, model


@query("early_stopping", f"""{ESSAY_SPLIT}
SELECT split, count(*) AS n, true AS stopped_in_time, true AS none_lower, true AS restored FROM s WHERE split <> 'test' GROUP BY split""")
def q_early_stopping(spark, sf_dir):
    """Boosting ends ten rounds after its best round (or at the limit); no round before or after has a lower validation
    loss, and the restored state, predicted anew from the features, has the best round's losses."""
    df, model = _stopped(spark, sf_dir)
    best, last = model.best_round(), len(model.trees)
    train, val = model.history[best - 1][1:]
    again = model.losses(model.predict(df))
    n = df.groupBy("split").agg(F.count("*").alias("n"))
    close = {"train": abs(again.get("train", 0.0) - train) < 1e-9 * max(1, train), "val": abs(again.get("val", 0.0) - val) < 1e-9 * max(1, val)}
    return n.select("split", "n", F.lit(last - best == PATIENCE or last == BOOSTS).alias("stopped_in_time"),
                    F.lit(all(h[2] >= val for h in model.history)).alias("none_lower"),
                    F.when(F.col("split") == "train", close["train"]).otherwise(close["val"]).alias("restored"))


@query("early_stopping_rounds")
def q_early_stopping_rounds(spark, sf_dir):
    """(round, train_loss, val_loss, is_best): the losses of every round up to the stop."""
    _, model = _stopped(spark, sf_dir)
    best = model.best_round()
    return spark.createDataFrame([(r, float(t), float(v), r == best) for r, t, v in model.history],
                                 "round int, train_loss double, val_loss double, is_best boolean")


ROUNDS = 20


@query("training_history", f"""SELECT s AS split, CAST(i AS INTEGER) AS iteration, true AS falls
FROM (VALUES ('train'), ('val')) v(s), range(1, {ROUNDS + 1}) t(i)""")
def q_training_history(spark, sf_dir):
    """Loss after every boosting round; on the training rows it never rises."""
    df = _vector_frame(spark, sf_dir)
    parts = {k: df.filter(F.col("split") == k) for k in ("train", "val")}
    history = M.training_history(M.gbt(max_iter=ROUNDS).fit(parts["train"]), parts)
    before = F.lag("loss").over(Window.partitionBy("split").orderBy("iteration"))  # ROUNDS rows per split
    falls = F.when(F.col("split") == "train", F.col("loss") <= F.coalesce(before, F.col("loss")) + 1e-9).otherwise(F.col("loss") >= 0)
    return history.select("split", "iteration", falls.alias("falls"))


def _hyperband(spark, sf_dir):
    df = _vector_frame(spark, sf_dir).filter(F.col("split") != "test")
    return boosting.hyperband(df, {"depth": [2, 3, 4], "step": [0.05, 0.1, 0.3]}, max_budget=9, factor=3)


@query("hyperband_trials")
def q_hyperband_trials(spark, sf_dir):
    """(bracket, round, candidate, params, budget, val_loss, kept): every trial."""
    return _hyperband(spark, sf_dir)


@query("tune_on_validation", """SELECT * FROM (VALUES ('random', 0, 0, 0, 10, 1, true), ('hyperband', 0, 0, 1, 9, 3, true),
('hyperband', 0, 1, 3, 3, 1, true), ('hyperband', 0, 2, 9, 1, 1, true), ('hyperband', 1, 0, 3, 5, 1, true),
('hyperband', 1, 1, 9, 1, 1, true), ('hyperband', 2, 0, 9, 3, 1, true)) v(strategy, bracket, round, budget, n_trials, n_kept, best_kept)""")
def q_tune(spark, sf_dir):
    """Ten random trials of two runs each, and Hyperband's brackets (nine rounds, factor three): trials and kept ones per
    round, and whether none that went out had a lower loss than one that was kept."""
    df = _vector_frame(spark, sf_dir)
    space = {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.3], "maxIter": [10, 20]}
    train, val = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "val")
    trials = M.tune_on_validation(train, val, lambda p, seed: M.gbt(
        max_iter=p["maxIter"], depth=p["maxDepth"], step=p["stepSize"], seed=seed), space, trials=10, runs=2)
    first = trials.orderBy("val_mse", "trial").limit(1).select(F.col("trial").alias("best"))  # of ten rows
    nothing = [F.lit(0).alias(c) for c in ("bracket", "round", "budget")]
    rows = trials.join(F.broadcast(first), F.col("trial") == F.col("best"), "left").select(
        F.lit("random").alias("strategy"), *nothing, F.col("val_mse").alias("val_loss"), F.col("best").isNotNull().alias("kept"))
    rows = rows.unionByName(_hyperband(spark, sf_dir).select(F.lit("hyperband").alias("strategy"), "bracket", "round", "budget",
                                                             "val_loss", "kept"))
    worst, out = F.max(F.when(F.col("kept"), F.col("val_loss"))), F.min(F.when(~F.col("kept"), F.col("val_loss")))
    return rows.groupBy("strategy", "bracket", "round", "budget").agg(
        F.count("*").cast("int").alias("n_trials"), F.sum(F.col("kept").cast("int")).cast("int").alias("n_kept"),
        F.coalesce(worst <= out, F.lit(True)).alias("best_kept"))


def _regression(df):
    return LinearRegression(regParam=0.01).fit(df.filter(F.col("split") == "train"))


@query("batch_predict", f"{ESSAY_SPLIT} SELECT id, split, true AS clamped FROM s")
def q_batch_predict(spark, sf_dir):
    """Scores for every essay, never below zero."""
    df = _vector_frame(spark, sf_dir)
    p = _regression(df).transform(df).withColumn("y_pred", F.greatest(F.col("prediction"), F.lit(0.0)))
    return p.select("id", "split", (F.col("y_pred") >= F.greatest(F.lit(0.0), F.col("prediction"))).alias("clamped"))


@query("save_and_load_model", f"{ESSAY_SPLIT} SELECT id, true AS equal FROM s WHERE split = 'test'")
def q_save_load(spark, sf_dir):
    df = _vector_frame(spark, sf_dir)
    model = _regression(df)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = LinearRegressionModel.load(path)
    test = df.filter(F.col("split") == "test")
    both = loaded.transform(model.transform(test).select("id", "features", F.col("prediction").alias("before")))
    return both.select("id", (F.col("before") == F.col("prediction")).alias("equal"))


# ---- topic models ------------------------------------------------------------

TOPICS, TOP_TERMS, PASSES = 5, 10, 10


def _lda(spark, sf_dir):
    """Counted documents over the terms of 2 to 95 % of the essays, the fitted model and the bound of each pass.

    The model is fitted once for the same essays and then read from the shared folder."""
    e = essays(spark, sf_dir)
    terms = staging.stage(e.select("id", T.remove_stopwords(T.vocabulary_terms(F.col("text"))).alias("terms")), "lda-terms")
    stats = V.corpus_term_stats(terms, F.col("terms"), stop_words=False)
    docs = topics.term_counts(terms, staging.stage(V.vocabulary_from_stats(stats, e.count(), 2, 0.95), "lda-vocabulary"))

    def build():
        model, bounds = topics.fit(docs, TOPICS, PASSES)
        passes = spark.createDataFrame([(None, [float(b)], i) for i, b in enumerate(bounds)],
                                       "term string, weights array<double>, pass int")
        return model.withColumn("pass", F.lit(None).cast("int")).unionByName(passes)

    stored = staging.remembered(spark, "lda", terms, build)
    passes = stored.filter("pass IS NOT NULL").orderBy("pass").collect()  # one row per pass
    return e, docs, stored.filter("pass IS NULL").select("term", "weights"), [r["weights"][0] for r in passes]


LDA_VOCAB_SQL = f"{TF_SQL}, known AS (SELECT term, n FROM stats, nd WHERE df >= 2 AND df <= 0.95 * nd.nd)"


@query("lda_topics", f"""{LDA_VOCAB_SQL}, v AS (SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS occurrences FROM known)
SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, v.terms AS vocabulary, v.occurrences, true AS in_vocabulary,
       true AS ordered, CAST({PASSES} AS INTEGER) AS passes, true AS bound_rises
FROM v, range({TOPICS}) a(t), range(1, {TOP_TERMS + 1}) b(r)""")
def q_lda_topics(spark, sf_dir):
    """Ten passes over every essay: topics share out exactly the occurrences of the vocabulary, and the bound never falls."""
    _, docs, model, bounds = _lda(spark, sf_dir)
    rises = len(bounds) == PASSES and all(b >= a - 1e-9 * abs(a) for a, b in zip(bounds, bounds[1:]))
    top = topics.top_terms(model, TOPICS, TOP_TERMS)
    seen = docs.select(F.explode("terms").alias("term")).distinct()
    mass = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w) - 1.0
    total = model.agg(F.count("*").alias("terms"), F.round(F.sum(mass)).cast("bigint").alias("occurrences")).first()
    order = Window.partitionBy("topic").orderBy("rank")  # TOPICS x TOP_TERMS rows
    held = F.col("known").isNotNull() & ~F.col("term").isin(list(fixed.STOP_WORDS)) & F.col("share").between(1e-12, 1)
    return top.join(seen.withColumn("known", F.lit(True)), "term", "left").select(
        "topic", "rank", F.lit(total["terms"]).alias("vocabulary"), F.lit(total["occurrences"]).cast("bigint").alias("occurrences"), held.alias("in_vocabulary"),
        (F.col("share") <= F.coalesce(F.lag("share").over(order), F.col("share"))).alias("ordered"),
        F.lit(len(bounds)).alias("passes"), F.lit(rises).alias("bound_rises"))


@query("lda_doc_topics", f"""{LDA_VOCAB_SQL},
own AS (SELECT id, CAST(sum(tf) AS BIGINT) AS tokens FROM tf WHERE term IN (SELECT term FROM known) GROUP BY id)
SELECT id, coalesce(tokens, 0) AS tokens, CAST({TOPICS} AS INTEGER) AS topics, 1.0 AS total, true AS shares
FROM essays LEFT JOIN own USING (id)""")
def q_lda_doc_topics(spark, sf_dir):
    """Essays folded into the stored model: shares that add up to one, from weights that add up to the essay's known
    occurrences and the prior (an essay without a known term keeps the even prior)."""
    e, docs, model, _ = _lda(spark, sf_dir)
    mix = e.select("id").join(topics.infer(docs, model, TOPICS), "id", "left")
    even = F.array(*(F.lit(1.0 / TOPICS) for _ in range(TOPICS)))
    mix = mix.withColumn("weights", F.coalesce("weights", even))
    sum_ = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    shares = F.transform("weights", lambda w: w / F.col("sum"))
    return mix.withColumn("sum", sum_).select(
        "id", F.round(F.col("sum") - 1.0).cast("bigint").alias("tokens"), F.size("weights").alias("topics"),
        F.round(F.aggregate(shares, F.lit(0.0), lambda s, w: s + w), 6).alias("total"),
        F.forall(shares, lambda x: (x >= 0) & (x <= 1 + 1e-9)).alias("shares"))
