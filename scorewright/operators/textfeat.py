"""Per-essay annotation and the 30 predictors, as one projection.

``annotate`` adds the annotation columns (corrected text, tokens, lines,
entities, tags, lemmas) and ``count_features`` turns them into counts, both
by built-in and higher-order functions.  ``essay_features`` needs the counts
alone and takes them from ``essay_counts``, one Arrow pass over the text.
Neither explodes or shuffles.  Only the
reference similarity needs a shuffle (bag-of-words cosine, see
``reference_similarity``).

Re-aimed annotators: the pretrained tagger, entity recogniser, grammar
checker and lemmatiser of the reference are replaced by the rule and
lexicon tables in ``scorewright.functions.fixed``; they compute the same
kind of column, not the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorewright.functions import counting, fixed, text as T
from scorewright.operators import relational
from scorewright.sources import staging

PREDICTORS = fixed.PREDICTORS
#: Words of all reference essays together that are sent to the tasks, at most.
MOST_TERMS = 500_000


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Add corrections, corrected, tokens, sents, ner, pos and lemma columns."""
    t = F.col(text)
    out = df.withColumns({"corrections": T.grammar_corrections(t), "corrected": T.correct_text(t)})
    c = F.col("corrected")
    out = out.withColumns({
        "tokens": T.word_tokens(c),
        "sents": T.line_sentences(c),
        "ner": T.entities(c),
    })
    return out.withColumns({
        "pos": T.pos_tags(F.col("tokens")),
        "lemma": F.transform(F.transform(F.col("tokens"), F.lower), T.lemma),
    })


def count_features(ann: DataFrame) -> DataFrame:
    """Scalar predictors from an annotated frame (everything except similarity)."""
    c = F.col("corrected")
    tokens = F.col("tokens")
    cols = {
        "token_count": F.size(tokens).cast("bigint"),
        "unique_token_count": F.size(F.array_distinct(tokens)).cast("bigint"),
        "nostop_count": F.size(T.remove_stopwords(tokens)).cast("bigint"),
        # the number of lines; stripping them (the "sents" column) does not change it
        "sent_count": F.size(F.split(c, "\n", -1)).cast("bigint"),
        "ner_count": F.size(F.col("ner")).cast("bigint"),
        "comma": T.literal_count(c, ","),
        "question": T.literal_count(c, "?"),
        "exclamation": T.literal_count(c, "!"),
        "quotation": T.literal_count(c, '"') + T.literal_count(c, "'"),
    }
    for name, mark in fixed.PLACEHOLDERS:
        cols[name] = T.literal_count(c, mark)
    for name, tag in fixed.POS_FEATURES:
        cols[name] = T.tag_count(F.col("pos"), tag)
    return ann.withColumns(cols)


def reference_essays(essays: DataFrame, topic: str = "topic", score: str = "score", key: str = "id") -> DataFrame:
    """(topic, ref_id): the top-scored essay of each topic, lowest id on ties.

    A ``min(struct)`` aggregate, not a window: no task ever holds a whole topic.
    """
    return relational.first_per_group(essays, topic, [-F.col(score), F.col(key)], [key]) \
        .withColumnRenamed(key, "ref_id")


def term_frequencies(df: DataFrame, terms, key: str = "id", keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., term, tf) from an array-of-terms expression.

    explode keeps rows in their task; the aggregate on (key, term) combines
    repeats map-side, so only distinct (document, term) pairs are shuffled.
    """
    keep = keep or []
    return df.select(key, *keep, F.explode(terms).alias("term")) \
        .groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def sum_squared_counts(words: Column) -> Column:
    """Sum over distinct words of (occurrences)^2, in-row: run lengths of the sorted array."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("bigint").alias("run"),
                    F.lit(0).cast("bigint").alias("ss"))

    def step(acc, w):
        same = F.coalesce(acc["prev"] == w, F.lit(False))
        return F.struct(w.alias("prev"),
                        F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"),
                        F.when(same, acc["ss"]).otherwise(acc["ss"] + acc["run"] * acc["run"]).alias("ss"))

    # sort_array: array_sort would call a lambda for every comparison
    return F.aggregate(F.sort_array(words), zero, step, lambda acc: acc["ss"] + acc["run"] * acc["run"])


def reference_terms(essays: DataFrame, text: str = "text", topic: str = "topic") -> DataFrame:
    """(topic, term, rtf, rnorm): the term counts of each topic's reference essay and their norm, staged.

    Staging gives the table a size that Spark knows when it plans the join with the essays' words:
    it broadcasts it below its threshold and shuffles beyond.
    """
    refs = staging.stage(reference_essays(essays), "reference-ids")
    ref_docs = essays.join(refs.withColumnRenamed("ref_id", "id"), ["id", topic], "left_semi")
    counts = ref_docs.select(topic, F.explode(T.word_runs(F.col(text))).alias("term")).groupBy(topic, "term") \
        .agg(F.count(F.lit(1)).alias("rtf"))
    norm = F.sqrt(F.sum(F.col("rtf") * F.col("rtf")).over(Window.partitionBy(topic)))
    return staging.stage(counts.withColumn("rnorm", norm), "reference-terms")


def with_similarity(essays: DataFrame, rows: DataFrame, refs: DataFrame, text: str = "text", topic: str = "topic") -> DataFrame:
    """``rows`` (with id, topic and the in-row ``_norm``) plus their cosine with the topic's reference essay.

    The dot product sums the reference count of every word occurrence: exploded words meet the
    reference terms, and the sum is combined map-side to one row per essay before its shuffle, so no
    (essay, term) table moves.  Essays that share no word get 0.
    """
    occurrences = essays.select("id", topic, F.explode(T.word_runs(F.col(text))).alias("term"))
    dots = occurrences.join(refs, [topic, "term"]).groupBy("id").agg(
        F.sum("rtf").alias("_dot"), F.max("rnorm").alias("_rnorm"))
    return cosines(rows.join(dots, "id", "left"))


def cosines(rows: DataFrame) -> DataFrame:
    """``similarity`` from ``_dot``, ``_norm`` and ``_rnorm``, which it drops; 0 where there is none."""
    sim = F.try_divide(F.col("_dot").cast("double"), F.col("_norm") * F.col("_rnorm"))
    return rows.withColumn("similarity", F.coalesce(sim, F.lit(0.0))).drop("_dot", "_rnorm", "_norm")


def essay_norm(text: str = "text") -> Column:
    return F.sqrt(sum_squared_counts(T.word_runs(F.col(text))).cast("double"))


def reference_similarity(essays: DataFrame, text: str = "text", topic: str = "topic") -> DataFrame:
    """(id, topic, similarity): cosine of term-frequency vectors against the topic's reference essay."""
    rows = essays.select("id", topic, essay_norm(text).alias("_norm"))
    return with_similarity(essays, rows, reference_terms(essays, text, topic), text, topic)


def essay_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the predictors of ``count_features(annotate(df))`` and ``squares``, the squared word counts.

    The same correction, tokens, entities and tags, but made and counted in one Arrow pass over the text:
    the expressions build every annotation as an array and call a lambda for each of its elements."""
    counted = F.arrow_udf(counting.count_batch, counting.TYPE)
    return df.withColumn("_counts", counted(F.col(text))).select("*", "_counts.*").drop("_counts")


def counts_and_dots(df: DataFrame, refs: DataFrame, text: str = "text", topic: str = "topic") -> DataFrame:
    """``essay_counts`` with ``_dot`` and ``_rnorm``, the product with the topic's reference essay, from the same pass.

    As where the products are joined on the id, rows that share an id have their products together, and a
    null id has none."""
    terms, norms = {}, {}
    for r in refs.collect():  # the words of one essay per topic, MOST_TERMS at most
        terms.setdefault(r[topic], {})[r["term"]] = r["rtf"]
        norms[r[topic]] = r["rnorm"]
    counted = F.arrow_udf(counting.counter(terms), counting.DOT_TYPE)
    out = df.withColumn("_counts", counted(F.col(text), F.col(topic))).select("*", "_counts.*").drop("_counts")
    norm = F.create_map(*[F.lit(x) for pair in norms.items() for x in pair])[F.col(topic)] if norms else F.lit(None)
    out = out.withColumn("_rnorm", F.when(F.col("dot") > 0, norm.cast("double")))
    # rows without an id are alone: no task gets all of them
    same = Window.partitionBy("id", F.when(F.col("id").isNull(), F.xxhash64(*counting.NAMES)))
    known = F.col("id").isNotNull()
    return out.select(*df.columns, *counting.NAMES, F.when(known, F.sum("dot").over(same)).alias("_dot"),
                      F.when(known, F.max("_rnorm").over(same)).alias("_rnorm"))


def essay_features(essays: DataFrame, text: str = "text", target: str = "score",
                   topic: str = "topic") -> DataFrame:
    """(id, topic, target_score, 30 predictors): one pass over the text, given the words of the reference essays.

    More reference words than ``MOST_TERMS`` (topics are few) are not sent to every task but joined."""
    slim = essays.select("id", topic, target, text)
    refs = reference_terms(slim, text, topic)
    counted = [p for p in PREDICTORS if p != "similarity"]
    norm = F.sqrt(F.col("squares").cast("double")).alias("_norm")
    if refs.schema[topic].dataType == StringType() and refs.count() <= MOST_TERMS:
        out = cosines(counts_and_dots(slim, refs, text, topic).select("id", topic, target, norm, "_dot", "_rnorm", *counted))
    else:
        rows = essay_counts(slim, text).select("id", topic, target, norm, *counted)
        out = with_similarity(slim, rows, refs, text, topic)
    return out.select("id", topic, F.col(target).cast("double").alias("target_score"), *PREDICTORS)


def embedding_similarity(emb: DataFrame, key: str = "vec_id", vec: str = "embedding",
                         group: str = "label") -> DataFrame:
    """Cosine of each vector against its group's reference vector (lowest key)."""
    refs = relational.first_per_group(emb, group, [F.col(key)], [key]).withColumnRenamed(key, "ref_id")
    refs = staging.stage(refs, "reference-vector-ids")
    ref_vec = emb.join(refs.withColumnRenamed("ref_id", key), [key, group], "left_semi") \
        .select(group, F.col(vec).alias("ref_vec"))
    ref_vec = staging.stage(ref_vec, "reference-vectors")  # one vector per group, of known size: no shuffle on the group
    d = F.transform(F.col(vec), lambda x: x.cast("double"))
    r = F.transform(F.col("ref_vec"), lambda x: x.cast("double"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cos = F.try_divide(dot(d, r), F.sqrt(dot(d, d)) * F.sqrt(dot(r, r)))
    return emb.join(ref_vec, group).select(key, group, cos.alias("similarity"))


def _match_step(rule_id: str):
    """Append a match at the running offset and move the offset behind it."""
    def step(acc, s):
        size = F.length(s["match"]).cast("bigint")
        here = acc["at"] + s["gap"]
        one = F.struct(F.lit(rule_id).alias("rule_id"), here.alias("offset"), size.alias("length"), s["match"].alias("match"))
        return F.struct((here + size).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return step


def grammar_match_details(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, rule_id, offset, length, replacement): one row per rule match (re-aimed grammar check).

    Spark has no regex-position function, so offsets come from the text split on the same
    regex: the k-th match starts after the first k pieces and the k-1 earlier matches.  One
    left-to-right ``aggregate`` per rule carries that running offset and collects the matches;
    the rules' arrays are concatenated in one projection (one scan) and exploded once.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(
        "array<struct<rule_id:string,offset:bigint,length:bigint,match:string>>").alias("found"))
    rules = []
    for rule_id, pattern, _ in fixed.GRAMMAR_RULES:
        matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(F.col(text), pattern, -1), lambda p: F.length(p).cast("bigint"))
        steps = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))),
                         lambda s: s["match"].isNotNull())

        rules.append(F.when(F.regexp_count(F.col(text), F.lit(pattern)) > 0,
                            F.aggregate(steps, start, _match_step(rule_id), lambda acc: acc["found"])).otherwise(start["found"]))
    x = df.select(key, F.inline(F.concat(*rules)))
    replacement = F.col("match")
    cases = None
    for rule_id, pattern, repl in fixed.GRAMMAR_RULES:
        fixed_up = F.regexp_replace("match", pattern, repl)
        hit = F.col("rule_id") == rule_id
        cases = F.when(hit, fixed_up) if cases is None else cases.when(hit, fixed_up)
    return x.select(key, "rule_id", "offset", "length", cases.otherwise(replacement).alias("replacement"))
