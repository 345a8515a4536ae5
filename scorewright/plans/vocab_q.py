"""Vocabulary, TF-IDF, sequence and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import textfeat, vocab as V
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.plans.text_q import ANN_SQL
from scorewright.sources import essays, load, staging

E = S.ESSAYS

TF_SQL = f"""WITH {E},
terms AS (SELECT id, unnest({S.remove_stopwords(S.vocabulary_terms('text'))}) AS term FROM essays),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS nd FROM essays)"""

# TF-IDF reads the lemmatised essays
LEMMA_TF_SQL = f"""{ANN_SQL},
lem AS (SELECT id, array_to_string(list_transform(tokens, lambda x: {S.lemma('lower(x)')}), ' ') AS l_essay FROM ann),
terms AS (SELECT id, unnest({S.remove_stopwords(S.vocabulary_terms('l_essay'))}) AS term FROM lem),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS nd FROM essays)"""

VOCAB_SQL = f"""{LEMMA_TF_SQL},
vocab AS (SELECT term, df, n FROM stats, nd WHERE df >= 3 AND df <= 0.2 * nd.nd ORDER BY n DESC, term LIMIT 2000)"""

# TF-IDF vocabulary parameters of the reference's regression features
MIN_DF, MAX_DF, MAX_FEATURES = 3, 0.2, 2000
#: Essays whose terms one task counts about, partitions at least.
COUNTED_ROWS, LEAST_PARTS = 5_000, 24


def lemma_terms(e):
    """(id, terms): count-vectoriser terms of the lemmatised essay, stop words out."""
    ann = textfeat.annotate(e.select("id", "text")).select("id", F.array_join("lemma", " ").alias("l_essay"))
    return ann.select("id", T.remove_stopwords(T.vocabulary_terms(F.col("l_essay"))).alias("terms"))


def tfidf_vocabulary(docs):
    """Staged docs (id, terms) and the staged vocabulary (at most MAX_FEATURES rows) with the number of essays."""
    docs = staging.stage(docs, "lemma-terms")
    n = docs.count()
    stats = V.corpus_term_stats(docs, F.col("terms"), stop_words=False)
    return docs, staging.stage(V.vocabulary_from_stats(stats, n, MIN_DF, MAX_DF, MAX_FEATURES), "vocabulary"), n


def assembled(e):
    """(id, topic, target_score, predictors, tfidf vector): the row that the search fits on.

    Vector positions follow the vocabulary by falling count; it has MAX_FEATURES terms at most."""
    import math

    from scorewright.operators import models as M
    docs, vocab, n = tfidf_vocabulary(lemma_terms(e))
    rows = vocab.orderBy(F.col("n").desc(), "term").limit(MAX_FEATURES).collect()
    idf = [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in rows]
    vec = M.tfidf_vectorizer([r["term"] for r in rows], idf).transform(docs).select("id", "tfidf")
    return textfeat.essay_features(e).join(vec, "id")


def _tf(spark, sf_dir):
    e = essays(spark, sf_dir)
    return e, V.doc_terms(e, T.vocabulary_terms(F.col("text")))


@query("top_terms", f"{TF_SQL} SELECT term, CAST(n AS BIGINT) AS n FROM (SELECT * FROM stats ORDER BY n DESC, term LIMIT 20)")
def q_top_terms(spark, sf_dir):
    e = essays(spark, sf_dir)
    return V.top_terms_from_stats(V.corpus_term_stats(e, T.vocabulary_terms(F.col("text"))), 20)


@query("doc_term_counts", f"{TF_SQL} SELECT id, term, tf FROM tf")
def q_doc_term_counts(spark, sf_dir):
    return _tf(spark, sf_dir)[1]


@query("bounded_vocabulary", f"{VOCAB_SQL} SELECT term, df, CAST(n AS BIGINT) AS n FROM vocab")
def q_bounded_vocabulary(spark, sf_dir):
    return tfidf_vocabulary(lemma_terms(essays(spark, sf_dir)))[1]


@query("count_vocabulary", f"""{TF_SQL}
SELECT term, df, CAST(n AS BIGINT) AS n FROM stats, nd WHERE df >= 2 AND df <= 0.95 * nd.nd""")
def q_count_vocabulary(spark, sf_dir):
    """The uncapped vocabulary of the topic model: terms of at least two and at most 95 % of the essays."""
    e = essays(spark, sf_dir)
    stats = V.corpus_term_stats(e, T.vocabulary_terms(F.col("text")))
    return V.vocabulary_from_stats(stats, e.count(), 2, 0.95)


@query("tfidf", f"""{VOCAB_SQL},
w AS (SELECT tf.id, tf.term, tf.tf * (ln((1 + nd.nd) / (1 + v.df)) + 1) AS w FROM tf JOIN vocab v USING (term), nd)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS tfidf FROM w""")
def q_tfidf(spark, sf_dir):
    docs, vocab, n = tfidf_vocabulary(lemma_terms(essays(spark, sf_dir)))
    # only occurrences of vocabulary terms reach the (document, term) aggregate; the norm's window reuses its key.
    # As many partitions as essays ask for: Spark would merge them by their compressed bytes, of which a few hold many rows
    occ = docs.select("id", F.explode("terms").alias("term")).join(vocab.select("term"), "term", "left_semi")
    tf = occ.repartition(max(-(-n // COUNTED_ROWS), LEAST_PARTS), "id").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return rounded(V.tfidf(tf, vocab, n))


def _ll(k, n, p):
    return f"(ln(greatest({p}, 1e-10::DOUBLE)) * {k} + ln(greatest(1 - {p}, 1e-10::DOUBLE)) * ({n} - {k}))"


COLLOCATION_SQL = f"""WITH {E},
w AS (SELECT {S.remove_stopwords(S.normalized_words('text'))} AS ws FROM essays),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
g AS (SELECT ws[i] AS a, ws[i + 1] AS b, count(*) AS n FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w) GROUP BY ALL),
f AS (SELECT g.a, g.b, g.n, g.n::DOUBLE AS k, x.n::DOUBLE AS n1, y.n::DOUBLE - g.n AS r, y.n::DOUBLE / t.n AS p,
             greatest(t.n::DOUBLE - x.n, 1) AS m
      FROM g JOIN c x ON g.a = x.word JOIN c y ON g.b = y.word, (SELECT sum(n) AS n FROM c) t),
scored AS (SELECT a, b, n, -2 * ({_ll('k', 'n1', 'p')} + {_ll('r', 'm', 'p')} - {_ll('k', 'n1', '(k / n1)')} - {_ll('r', 'm', '(r / m)')}) AS score
           FROM f),
pairs AS (SELECT * FROM scored WHERE score > {V.COLLOCATION})"""


@query("word_collocations", f"{COLLOCATION_SQL} SELECT a, b, n, round(score, 3) AS score FROM pairs")
def q_word_collocations(spark, sf_dir):
    words = essays(spark, sf_dir).select(T.remove_stopwords(T.normalized_words(F.col("text"))).alias("w"))
    return V.collocations(words)[1].select("a", "b", "n", F.round("score", 3).alias("score"))


@query("word_cloud_frequencies", f"""{COLLOCATION_SQL},
taken AS (SELECT word, sum(n) AS n FROM (SELECT a AS word, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY word),
terms AS (SELECT c.word AS term, CAST(c.n - coalesce(taken.n, 0) AS BIGINT) AS n FROM c LEFT JOIN taken USING (word)
          UNION ALL SELECT a || ' ' || b, n FROM pairs),
top AS (SELECT term, n FROM terms WHERE n > 0 ORDER BY n DESC, term LIMIT 200)
SELECT term, n, round(n / max(n) OVER (), 6) AS rel FROM top""")
def q_word_cloud(spark, sf_dir):
    return rounded(V.word_cloud_frequencies(essays(spark, sf_dir)))


CW_SQL = f"""WITH {E},
cw AS (SELECT id, {S.lemmatize(S.remove_stopwords(S.normalized_words('text')))} AS words FROM essays),
x AS (SELECT id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM cw),
c AS (SELECT term, count(*) AS n, min(id * 1000000 + pos) AS f FROM x GROUP BY term),
ix AS (SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS BIGINT) AS idx FROM c)"""


def _words(spark, sf_dir):
    return V.clean_words(essays(spark, sf_dir))


@query("token_index", f"{CW_SQL} SELECT term, n, idx FROM ix")
def q_token_index(spark, sf_dir):
    return V.token_index(_words(spark, sf_dir))


def _ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


ENC_SQL = f"""{CW_SQL},
enc AS (SELECT x.id, list(i.idx ORDER BY x.pos) AS seq FROM x JOIN ix i ON x.term = i.term AND i.idx < 5000 GROUP BY x.id),
seqs AS (SELECT e.id, coalesce(enc.seq, []) AS seq FROM essays e LEFT JOIN enc USING (id))"""


def _sequences(spark, sf_dir):
    w = _words(spark, sf_dir)
    return V.encode_sequences(w, V.top_index(w, 5000), 5000)


@query("encode_sequences", f"""{ENC_SQL}
SELECT id, CAST(len(seq) AS BIGINT) AS seq_len, array_to_string(seq, ',') AS seq FROM seqs""")
def q_encode_sequences(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("id", F.size("seq").cast("bigint").alias("seq_len"), _ints(F.col("seq")).alias("seq"))


@query("pad_sequences", f"""{ENC_SQL},
k AS (SELECT id, list_slice(seq, greatest(len(seq) - 499, 1), greatest(len(seq) - 499, 1) + 499) AS kept FROM seqs),
p AS (SELECT id, list_concat(list_transform(range(500 - len(kept)), lambda z: 0), kept) AS padded FROM k)
SELECT id, CAST(len(padded) AS BIGINT) AS padded_len, array_to_string(padded, ',') AS padded FROM p""")
def q_pad_sequences(spark, sf_dir):
    p = V.pad_sequences(_sequences(spark, sf_dir))
    return p.select("id", F.size("padded").cast("bigint").alias("padded_len"), _ints(F.col("padded")).alias("padded"))


RAW_SQL = f"""WITH {E},
cw AS (SELECT id, {S.word_tokens('lower(text)')} AS words FROM essays),
x AS (SELECT id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM cw),
c AS (SELECT term, count(*) AS n, min(id * 1000000 + pos) AS f FROM x GROUP BY term),
ix AS (SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS BIGINT) AS idx FROM c)"""


@query("encode_with_mask", f"""{RAW_SQL},
ids0 AS (SELECT x.id, list(coalesce(CASE WHEN i.idx < 5000 THEN i.idx + 3 END, 3) ORDER BY x.pos) AS ids
         FROM x LEFT JOIN ix i ON x.term = i.term WHERE x.pos < 510 GROUP BY x.id),
ids AS (SELECT e.id, list_concat([1], coalesce(ids0.ids, []), [2]) AS ids FROM essays e LEFT JOIN ids0 USING (id)),
tl AS (SELECT least(512, max(len(ids))) AS tl FROM ids),
p AS (SELECT id, list_concat(ids, list_transform(range(tl.tl - len(ids)), lambda z: 0)) AS ids FROM ids, tl)
SELECT id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(ids, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END), ',') AS attention_mask FROM p""")
def q_encode_with_mask(spark, sf_dir):
    w = essays(spark, sf_dir).select("id", T.word_tokens(F.lower("text")).alias("words"))
    enc = V.encode_with_mask(w, V.top_index(w, 5000), 5000, 512)
    return enc.select("id", F.size("input_ids").cast("bigint").alias("n_ids"), _ints(F.col("input_ids")).alias("input_ids"),
                      _ints(F.col("attention_mask")).alias("attention_mask"))


@query("normalize_vectors", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, CASE WHEN sqrt(list_dot_product(e, e)) > 0 THEN sqrt(list_dot_product(e, e)) ELSE 1.0 END AS nrm FROM v)
SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, round(x / nrm, 6) AS value
FROM (SELECT vec_id, nrm, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM n)""")
def q_normalize_vectors(spark, sf_dir):
    v = V.normalize_vectors(load(spark, sf_dir, "embeddings"))
    return rounded(V.vectors_long(v, "vec_id", "embedding"))


# the i-th term of the index gets row i of the embeddings as its vector, so known-word averages are exact in SQL
@query("average_word_vectors", f"""{CW_SQL},
vec AS (SELECT ix.term, e.embedding::DOUBLE[] AS v FROM ix JOIN embeddings e ON e.vec_id = ix.idx - 1),
kw AS (SELECT x.id, unnest(vec.v) AS value, unnest(range(len(vec.v))) AS dim FROM x JOIN vec ON x.term = vec.term),
m AS (SELECT id, dim, avg(value) AS value FROM kw GROUP BY id, dim),
g AS (SELECT essays.id, dim FROM essays, (SELECT unnest(range(max(len(embedding)))) AS dim FROM embeddings))
SELECT g.id, CAST(g.dim AS BIGINT) AS dim, round(coalesce(m.value, 0.0), 6) AS value FROM g LEFT JOIN m ON g.id = m.id AND g.dim = m.dim""")
def q_average_word_vectors(spark, sf_dir):
    w = staging.stage(_words(spark, sf_dir), "clean-words")
    emb = load(spark, sf_dir, "embeddings")
    index = V.token_index(w).select(F.col("term").alias("word"), (F.col("idx") - 1).alias("vec_id"))
    vectors = staging.stage(index.join(emb.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id"),
                            "indexed-vectors")
    dim = emb.agg(F.max(F.size("embedding"))).first()[0]
    return rounded(V.vectors_long(V.average_word_vectors(w, vectors, dim), "id", "vector"))


@query("mean_vectors", """SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(avg(x), 6) AS value
FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
GROUP BY label, i""")
def q_mean_vectors(spark, sf_dir):
    return rounded(V.mean_vectors(load(spark, sf_dir, "embeddings"), "label"))
