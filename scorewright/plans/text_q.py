"""Per-essay text feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import fixed, text as T
from scorewright.operators import annotate as A, textfeat
from scorewright.plans import sql as S
from scorewright.plans.catalog import query, rounded
from scorewright.sources import essays, load, staging

E = S.ESSAYS

ANN_SQL = f"""WITH {E},
ann0 AS (SELECT id, topic, score, text, {S.grammar_corrections('text')} AS corrections,
                {S.correct_text('text')} AS corrected FROM essays),
ann1 AS (SELECT *, {S.word_tokens('corrected')} AS tokens, {S.line_sentences('corrected')} AS sents,
                {S.entities('corrected')} AS ner FROM ann0),
ann AS (SELECT *, {S.pos_tags('tokens')} AS pos FROM ann1)"""

SIM_SQL = f"""tf AS (SELECT id, topic, term, count(*) AS tf
       FROM (SELECT id, topic, unnest({S.word_runs('text')}) AS term FROM essays) GROUP BY id, topic, term),
refs AS (SELECT topic, id AS ref_id FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rn
         FROM essays) WHERE rn = 1),
rtf AS (SELECT tf.topic, tf.term, tf.tf AS rtf FROM tf JOIN refs ON tf.id = refs.ref_id AND tf.topic = refs.topic),
rnorm AS (SELECT topic, sqrt(sum(rtf * rtf)) AS rnorm FROM rtf GROUP BY topic),
dots AS (SELECT tf.id, tf.topic, sum(tf.tf * coalesce(rtf.rtf, 0)) AS dot, sqrt(sum(tf.tf * tf.tf)) AS norm
         FROM tf LEFT JOIN rtf ON tf.topic = rtf.topic AND tf.term = rtf.term GROUP BY tf.id, tf.topic),
sim AS (SELECT e.id, e.topic, coalesce(d.dot::DOUBLE / nullif(d.norm * r.rnorm, 0), 0.0) AS similarity
        FROM essays e LEFT JOIN dots d ON e.id = d.id LEFT JOIN rnorm r ON d.topic = r.topic)"""


def _e(spark, sf_dir):
    return essays(spark, sf_dir)


def _ann(spark, sf_dir):
    return textfeat.annotate(_e(spark, sf_dir).select("id", "topic", "score", "text"))


@query("word_count", f"WITH {E} SELECT id, word_count FROM essays")
def q_word_count(spark, sf_dir):
    return _e(spark, sf_dir).select("id", "word_count")


@query("unique_words", f"WITH {E} SELECT id, CAST(len(list_distinct({S.whitespace_words('text')})) AS BIGINT) AS unique_words FROM essays")
def q_unique_words(spark, sf_dir):
    return _e(spark, sf_dir).select("id", T.unique_word_count(F.col("text")).alias("unique_words"))


@query("normalize_words", f"""WITH {E}, w AS (SELECT id, {S.normalized_words('text')} AS ws FROM essays)
SELECT id, CAST(len(ws) AS BIGINT) AS n_words, array_to_string(ws, ' ') AS words FROM w""")
def q_normalize_words(spark, sf_dir):
    ws = T.normalized_words(F.col("text"))
    return _e(spark, sf_dir).select("id", F.size(ws).cast("bigint").alias("n_words"), F.array_join(ws, " ").alias("words"))


@query("remove_stopwords", f"""WITH {E}, w AS (SELECT id, {S.remove_stopwords(S.normalized_words('text'))} AS ws FROM essays)
SELECT id, CAST(len(ws) AS BIGINT) AS n_kept, array_to_string(ws, ' ') AS kept FROM w""")
def q_remove_stopwords(spark, sf_dir):
    ws = T.remove_stopwords(T.normalized_words(F.col("text")))
    return _e(spark, sf_dir).select("id", F.size(ws).cast("bigint").alias("n_kept"), F.array_join(ws, " ").alias("kept"))


@query("lemmatize_tokens", f"""WITH {E}
SELECT id, array_to_string({S.lemmatize(S.normalized_words('text'))}, ' ') AS lemmas FROM essays""")
def q_lemmatize(spark, sf_dir):
    return _e(spark, sf_dir).select("id", F.array_join(T.lemmatize(T.normalized_words(F.col("text"))), " ").alias("lemmas"))


@query("clean_corpus", f"WITH {E} SELECT id, {S.clean_corpus('text')} AS clean_text FROM essays")
def q_clean_corpus(spark, sf_dir):
    return _e(spark, sf_dir).select("id", T.clean_corpus(F.col("text")).alias("clean_text"))


@query("join_lemmas", f"""{ANN_SQL}
SELECT id, array_to_string(list_transform(tokens, lambda x: {S.lemma('lower(x)')}), ' ') AS l_essay FROM ann""")
def q_join_lemmas(spark, sf_dir):
    return _ann(spark, sf_dir).select("id", F.array_join("lemma", " ").alias("l_essay"))


@query("word_tokens", f"""WITH {E}, t AS (SELECT id, {S.word_tokens('text')} AS tokens FROM essays)
SELECT id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM t""")
def q_word_tokens(spark, sf_dir):
    tok = T.word_tokens(F.col("text"))
    return _e(spark, sf_dir).select("id", F.size(tok).cast("bigint").alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


@query("line_sentences", f"""{ANN_SQL}
SELECT id, CAST(len(sents) AS BIGINT) AS sent_count, array_to_string(sents, ' | ') AS sentences FROM ann""")
def q_line_sentences(spark, sf_dir):
    return _ann(spark, sf_dir).select("id", F.size("sents").cast("bigint").alias("sent_count"),
                                      F.array_join("sents", " | ").alias("sentences"))


SENT_SQL = f"""WITH {E},
s AS (SELECT id, string_split(regexp_replace({S.strip('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM essays),
x AS (SELECT id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_no FROM s)"""


def _sentences(spark, sf_dir):
    e = _e(spark, sf_dir)
    marked = F.regexp_replace(T.strip(F.col("text")), r"([.!?])\s+", "$1\u0001")
    return e.select("id", F.posexplode(F.split(marked, "\u0001", -1)).alias("sent_no", "sentence")) \
        .withColumn("sent_no", F.col("sent_no").cast("bigint"))


@query("flatten_sentences", f"""{SENT_SQL}
SELECT id, sent_no, sentence FROM x WHERE {S.strip('sentence')} <> ''""")
def q_flatten_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).filter(T.strip(F.col("sentence")) != "")


@query("sentence_words", f"""{SENT_SQL}, w AS (SELECT id, sent_no, {S.normalized_words('sentence')} AS ws FROM x WHERE {S.strip('sentence')} <> '')
SELECT id, sent_no, CAST(len(ws) AS BIGINT) AS n_words, array_to_string(ws, ' ') AS words FROM w""")
def q_sentence_words(spark, sf_dir):
    s = _sentences(spark, sf_dir).filter(T.strip(F.col("sentence")) != "")
    ws = T.normalized_words(F.col("sentence"))
    return s.select("id", "sent_no", F.size(ws).cast("bigint").alias("n_words"), F.array_join(ws, " ").alias("words"))


def _match_rows_sql(rid, pattern, repl):
    m = f"regexp_extract_all(text, {S.q(pattern)})"
    return f"""SELECT id, {S.q(rid)} AS rule_id, k, m, pieces FROM (
      SELECT id, unnest(range(1, len({m}) + 1)) AS k, {m} AS m, string_split_regex(text, {S.q(pattern)}) AS pieces
      FROM essays WHERE len({m}) > 0)"""


RULE_ROWS = " UNION ALL ".join(_match_rows_sql(rid, p, r) for rid, p, r in fixed.GRAMMAR_RULES)
RULE_CASES = " ".join(f"WHEN {S.q(rid)} THEN regexp_replace(m[k], {S.q(p)}, {S.q(S.duck_repl(r))})"
                      for rid, p, r in fixed.GRAMMAR_RULES)


@query("grammar_matches", f"""WITH {E}, r AS ({RULE_ROWS})
SELECT id, rule_id,
       CAST(coalesce(list_sum(list_transform(pieces[1:k], lambda p: length(p))), 0)
            + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS offset,
       CAST(length(m[k]) AS BIGINT) AS length,
       CASE rule_id {RULE_CASES} END AS replacement
FROM r""")
def q_grammar_matches(spark, sf_dir):
    return textfeat.grammar_match_details(_e(spark, sf_dir))


@query("correct_text", f"""{ANN_SQL} SELECT id, corrections, corrected FROM ann""")
def q_correct_text(spark, sf_dir):
    return _ann(spark, sf_dir).select("id", "corrections", "corrected")


POS_SQL = ", ".join(f"{S.tag_count('pos', tag)} AS {name}" for name, tag in fixed.POS_FEATURES)


@query("pos_counts", f"{ANN_SQL} SELECT id, {POS_SQL} FROM ann")
def q_pos_counts(spark, sf_dir):
    f = textfeat.count_features(_ann(spark, sf_dir))
    return f.select("id", *[n for n, _ in fixed.POS_FEATURES])


@query("ner_entities", f"""{ANN_SQL} SELECT id, CAST(len(ner) AS BIGINT) AS ner_count, array_to_string(ner, '|') AS entities FROM ann""")
def q_ner(spark, sf_dir):
    return _ann(spark, sf_dir).select("id", F.size("ner").cast("bigint").alias("ner_count"),
                                      F.array_join("ner", "|").alias("entities"))


@query("token_count", f"{ANN_SQL} SELECT id, CAST(len(tokens) AS BIGINT) AS token_count FROM ann")
def q_token_count(spark, sf_dir):
    return textfeat.count_features(_ann(spark, sf_dir)).select("id", "token_count")


@query("unique_token_count", f"{ANN_SQL} SELECT id, CAST(len(list_distinct(tokens)) AS BIGINT) AS unique_token_count FROM ann")
def q_unique_token_count(spark, sf_dir):
    return textfeat.count_features(_ann(spark, sf_dir)).select("id", "unique_token_count")


@query("nostop_count", f"""{ANN_SQL} SELECT id, CAST(len({S.remove_stopwords('tokens')}) AS BIGINT) AS nostop_count FROM ann""")
def q_nostop_count(spark, sf_dir):
    return textfeat.count_features(_ann(spark, sf_dir)).select("id", "nostop_count")


@query("sent_count", f"{ANN_SQL} SELECT id, CAST(len(sents) AS BIGINT) AS sent_count FROM ann")
def q_sent_count(spark, sf_dir):
    return textfeat.count_features(_ann(spark, sf_dir)).select("id", "sent_count")


PUNCT_SQL = (f"{S.literal_count('corrected', ',')} AS comma, {S.literal_count('corrected', '?')} AS question, "
             f"{S.literal_count('corrected', '!')} AS exclamation, "
             f"{S.literal_count('corrected', chr(34))} + {S.literal_count('corrected', chr(39))} AS quotation")


@query("punctuation_counts", f"{ANN_SQL} SELECT id, {PUNCT_SQL} FROM ann")
def q_punct(spark, sf_dir):
    return textfeat.count_features(_ann(spark, sf_dir)).select("id", "comma", "question", "exclamation", "quotation")


PLACE_SQL = ", ".join(f"{S.literal_count('marked', m)} AS {n}" for n, m in fixed.PLACEHOLDERS)


@query("placeholder_counts", f"""WITH {E}, mk AS (SELECT id, {S.anonymize('text')} AS marked FROM essays)
SELECT id, {PLACE_SQL} FROM mk""")
def q_placeholders(spark, sf_dir):
    m = T.anonymize(F.col("text"))
    return _e(spark, sf_dir).select("id", *[T.literal_count(m, mark).alias(n) for n, mark in fixed.PLACEHOLDERS])


FEAT_SELECT = ", ".join([
    "a.corrections", "coalesce(s.similarity, 0.0) AS similarity",
    "CAST(len(a.tokens) AS BIGINT) AS token_count",
    "CAST(len(list_distinct(a.tokens)) AS BIGINT) AS unique_token_count",
    f"CAST(len({S.remove_stopwords('a.tokens')}) AS BIGINT) AS nostop_count",
    "CAST(len(a.sents) AS BIGINT) AS sent_count", "CAST(len(a.ner) AS BIGINT) AS ner_count",
    PUNCT_SQL.replace("corrected", "a.corrected"),
    ", ".join(f"{S.literal_count('a.corrected', m)} AS {n}" for n, m in fixed.PLACEHOLDERS),
    POS_SQL.replace("(pos,", "(a.pos,"),
])

FEATURES_SQL = f"""{ANN_SQL}, {SIM_SQL},
features AS (SELECT a.id, a.topic, CAST(a.score AS DOUBLE) AS target_score, {FEAT_SELECT}
             FROM ann a LEFT JOIN sim s ON a.id = s.id)"""


@query("essay_features", f"{FEATURES_SQL} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM features")
def q_essay_features(spark, sf_dir):
    return rounded(textfeat.essay_features(_e(spark, sf_dir)))


@query("reference_similarity", f"""WITH {E}, {SIM_SQL} SELECT id, topic, round(similarity, 6) AS similarity FROM sim""")
def q_reference_similarity(spark, sf_dir):
    return rounded(textfeat.reference_similarity(_e(spark, sf_dir)))


@query("join_topic_reference", f"""WITH {E},
refs AS (SELECT topic, id AS ref_id FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rn
         FROM essays) WHERE rn = 1)
SELECT e.id, e.topic, r.ref_id FROM essays e JOIN refs r ON e.topic = r.topic""")
def q_join_topic_reference(spark, sf_dir):
    e = _e(spark, sf_dir)
    refs = staging.stage(textfeat.reference_essays(e), "topic-references")  # known size: no shuffle on the topic
    return e.select("id", "topic").join(refs, "topic").select("id", "topic", "ref_id")


@query("sentiment_polarity", f"WITH {E} SELECT id, round({S.sentiment_polarity('text')}, 6) AS polarity FROM essays")
def q_sentiment(spark, sf_dir):
    return rounded(_e(spark, sf_dir).select("id", T.sentiment_polarity(F.col("text")).alias("polarity")))


@query("readability_flesch", f"WITH {E} SELECT id, round({S.flesch('text')}, 6) AS readability FROM essays")
def q_flesch(spark, sf_dir):
    return rounded(_e(spark, sf_dir).select("id", T.flesch_reading_ease(F.col("text")).alias("readability")))


@query("embedding_similarity", """WITH refs AS (SELECT label, min(vec_id) AS ref_id FROM embeddings GROUP BY label),
rv AS (SELECT e.label, e.embedding::DOUBLE[] AS r FROM embeddings e JOIN refs ON e.vec_id = refs.ref_id AND e.label = refs.label)
SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], rv.r)
       / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(rv.r, rv.r)), 0), 6) AS similarity
FROM embeddings e JOIN rv ON e.label = rv.label""")
def q_embedding_similarity(spark, sf_dir):
    return rounded(textfeat.embedding_similarity(load(spark, sf_dir, "embeddings")))


@query("annotate_batches", f"""WITH {E} SELECT id, CAST(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters FROM essays""")
def q_annotate_batches(spark, sf_dir):
    out = A.annotate_batches(_e(spark, sf_dir), A.count_letters, out="letters")
    return out.select("id", F.col("letters")[0].cast("bigint").alias("n_letters"))
