"""Joins, set operations and sorts hidden in the reference's lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import fixed, text as T
from scorewright.operators import relational as R, vocab as V
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.sources import essays, load

E = S.ESSAYS

WORDS_SQL = f"""WITH {E},
w AS (SELECT id, {S.normalized_words('text')} AS ws FROM essays),
x AS (SELECT id, CAST(unnest(range(len(ws))) AS BIGINT) AS pos, unnest(ws) AS word FROM w)"""


def _word_positions(spark, sf_dir):
    e = essays(spark, sf_dir)
    return e.select("id", F.posexplode(T.normalized_words(F.col("text"))).alias("pos", "word")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@query("anti_join_stopwords", f"{WORDS_SQL} SELECT id, pos, word FROM x WHERE word NOT IN {S.in_list(fixed.STOP_WORDS)}")
def q_anti_join(spark, sf_dir):
    stop = V.stopword_frame(spark)
    return _word_positions(spark, sf_dir).join(F.broadcast(stop), "word", "left_anti").select("id", "pos", "word")


@query("semi_join_vocabulary", f"""{WORDS_SQL},
terms AS (SELECT id, unnest({S.remove_stopwords(S.vocabulary_terms('text'))}) AS term FROM essays),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS nd FROM essays),
vocab AS (SELECT term FROM stats, nd WHERE df >= 3 AND df <= 0.2 * nd.nd ORDER BY n DESC, term LIMIT 2000)
SELECT id, pos, word FROM x WHERE word IN (SELECT term FROM vocab)""")
def q_semi_join(spark, sf_dir):
    e = essays(spark, sf_dir)
    stats = V.corpus_term_stats(e, T.vocabulary_terms(F.col("text")))
    vocab = V.vocabulary_from_stats(stats, e.count(), 3, 0.2, 2000).select(F.col("term").alias("word"))
    return _word_positions(spark, sf_dir).join(F.broadcast(vocab), "word", "left_semi").select("id", "pos", "word")


@query("lookup_join_vectors", """SELECT d.doc_id AS id, e.label, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def q_lookup_vectors(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    emb = load(spark, sf_dir, "embeddings")
    v = V.as_double_array("embedding")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return rounded(docs.join(emb.withColumnRenamed("vec_id", "id"), "id").select("id", "label", norm.alias("norm")))


@query("align_by_key", f"""WITH {E}
SELECT coalesce(e.id, l.doc_id) AS id, e.score, l.quality, l.toxic
FROM essays e FULL OUTER JOIN labels l ON e.id = l.doc_id""")
def q_align(spark, sf_dir):
    e = essays(spark, sf_dir).select("id", "score")
    lab = load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return e.join(lab, "id", "full_outer").select("id", "score", "quality", "toxic")


@query("union_score_buckets", f"""WITH {E}
SELECT id, score FROM essays WHERE score BETWEEN 1 AND 5
UNION ALL SELECT id, score FROM essays WHERE score BETWEEN 6 AND 10""")
def q_union_buckets(spark, sf_dir):
    e = essays(spark, sf_dir).select("id", "score")
    return R.union_all([e.filter(F.col("score").between(1, 5)), e.filter(F.col("score").between(6, 10))])


PUNCT_LIST = [c for c in fixed.PUNCTUATION]


@query("union_stopword_sets", f"""WITH {E},
t AS (SELECT unnest(list_transform({S.word_tokens('text')}, lambda x: lower(x))) AS word FROM essays)
SELECT word, count(*) AS n FROM t WHERE word IN (SELECT * FROM (VALUES {', '.join('(' + S.q(w) + ')' for w in fixed.STOP_WORDS + PUNCT_LIST)}) v(w)) GROUP BY word""")
def q_union_stopword_sets(spark, sf_dir):
    stop = V.stopword_frame(spark)
    punct = V.stopword_frame(spark, PUNCT_LIST)
    both = R.distinct_union(stop, punct)
    toks = essays(spark, sf_dir).select(F.explode(F.transform(T.word_tokens(F.col("text")), F.lower)).alias("word"))
    return toks.join(F.broadcast(both), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("order_by_score", f"""WITH {E}
SELECT id, score, CAST(row_number() OVER (ORDER BY score, id) AS BIGINT) AS rn FROM essays WHERE score BETWEEN 1 AND 10""")
def q_order_by_score(spark, sf_dir):
    e = R.filter_score_range(essays(spark, sf_dir).select("id", "score"))
    return R.row_number_by(e, [], ["score", "id"], "rn")


@query("top_k_global", f"WITH {E} SELECT id, word_count FROM essays ORDER BY word_count DESC, id LIMIT 10")
def q_top_k_global(spark, sf_dir):
    return R.top_k(essays(spark, sf_dir).select("id", "word_count"), 10, F.col("word_count").desc(), F.col("id"))


@query("top_k_per_group", f"""WITH {E}
SELECT topic, id, score, rank FROM (SELECT topic, id, score,
       CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS BIGINT) AS rank FROM essays) WHERE rank <= 3""")
def q_top_k_per_group(spark, sf_dir):
    e = essays(spark, sf_dir).select("topic", "id", "score")
    return R.top_k_per_group(e, "topic", 3, F.col("score").desc(), F.col("id"))
