"""Vocabularies, document-term tables, TF-IDF, sequences and vector averages.

The one large expansion in the workload is exploding documents into terms.
It happens once per operator, right after the scan, and is immediately
aggregated on (document, term) so that map-side combining shrinks it before
any shuffle.  Vocabulary-sized results (top terms, bounded vocabularies,
word indexes) are distributed top-k's; only tables whose size is bounded by
a parameter (``max_features``, ``num_words``) are broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scorewright.functions import fixed, text as T
from scorewright.operators.relational import row_number_by
from scorewright.sources import staging


def stopword_frame(spark, words=None) -> DataFrame:
    """The stop list as a one-column frame (fixed size: safe to broadcast)."""
    return spark.createDataFrame([(w,) for w in (words or fixed.STOP_WORDS)], "word string")


def doc_terms(df: DataFrame, terms: Column, key: str = "id", stop_words=True) -> DataFrame:
    """(key, term, tf): count-vectoriser terms of each document, stop words removed."""
    if stop_words:
        terms = T.remove_stopwords(terms, None if stop_words is True else stop_words)
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term") \
        .agg(F.count(F.lit(1)).alias("tf"))


def term_stats(tf: DataFrame, key: str = "id") -> DataFrame:
    """(term, df, n): document frequency and total count per term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def corpus_term_stats(docs: DataFrame, terms: Column, stop_words=True) -> DataFrame:
    """(term, df, n) straight from the documents, without a (document, term) shuffle.

    n counts occurrences; df counts documents, from each document's distinct
    terms (``array_distinct`` in-row).  Both are term-keyed aggregates that
    combine map-side, so a hot term costs one row per task.
    """
    if stop_words:
        terms = T.remove_stopwords(terms, None if stop_words is True else stop_words)
    # one explode per document: every occurrence tagged 0, each distinct term once more tagged 1
    t = docs.select(terms.alias("_t"))
    tagged = F.concat(F.transform("_t", lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"))),
                      F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"))))
    x = t.select(F.inline(tagged))
    return x.groupBy("term").agg(F.sum("d").alias("df"), F.sum(F.lit(1) - F.col("d")).alias("n")) \
        .select("term", "df", "n")


def top_terms_from_stats(stats: DataFrame, k: int = 20) -> DataFrame:
    return stats.orderBy(F.col("n").desc(), "term").limit(k).select("term", "n").orderBy("term")


def vocabulary_from_stats(stats: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
                          max_features: int | None = None) -> DataFrame:
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    if max_features:
        kept = kept.orderBy(F.col("n").desc(), "term").limit(max_features)
    return kept


def top_terms(tf: DataFrame, k: int = 20) -> DataFrame:
    """k most frequent terms (ties by term), listed alphabetically."""
    stats = term_stats(tf)
    return stats.orderBy(F.col("n").desc(), "term").limit(k).select("term", "n").orderBy("term")


def bounded_vocabulary(tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
                       max_features: int | None = None) -> DataFrame:
    """(term, df, n): min_df <= df <= max_df * n_docs, then the max_features most frequent by total count."""
    stats = term_stats(tf)
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    if max_features:
        kept = kept.orderBy(F.col("n").desc(), "term").limit(max_features)
    return kept


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int, key: str = "id") -> DataFrame:
    """(key, term, tfidf): tf * (ln((1+n)/(1+df)) + 1), each document scaled to unit L2 norm.

    How the vocabulary is joined is left to its size: a staged one is broadcast below Spark's threshold.
    """
    idf = vocab.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    w = tf.join(idf, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("_w") / norm).alias("tfidf"))


#: Log-likelihood ratio above which two adjacent words are one term.
COLLOCATION = 30.0


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    least = F.lit(1e-10)
    return F.log(F.greatest(p, least)) * k + F.log(F.greatest(1 - p, least)) * (n - k)


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio: does the second word follow the first more often than other words?

    Counts of the pair, of both words and of all words."""
    pair, first, second, total = (c.cast("double") for c in (pair, first, second, total))
    rest, others = second - pair, F.greatest(total - first, F.lit(1.0))
    alike, after, elsewhere = second / total, pair / first, rest / others
    return -2 * (_log_likelihood(pair, first, alike) + _log_likelihood(rest, others, alike)
                 - _log_likelihood(pair, first, after) - _log_likelihood(rest, others, elsewhere))


def adjacent(words: str) -> Column:
    """(a, b) of a column's neighbours: the words but the last beside the words but the first, without a lambda per word."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), most).alias("a"), F.slice(words, F.lit(2), most).alias("b"))


def collocations(words: DataFrame, threshold: float = COLLOCATION) -> tuple[DataFrame, DataFrame]:
    """(word, n) of ``words`` (w: word arrays), and (a, b, n, score) of the adjacent pairs that score above ``threshold``.

    Both counts combine map-side; the pair counts meet the words' counts in two joins, which Spark broadcasts or
    shuffles by the size of the staged counts.  Both results are staged."""
    single = staging.stage(words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = single.agg(F.sum("n")).first()[0] or 1
    counted = words.select(F.inline(adjacent("w")).alias("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    own = lambda name: single.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    scored = counted.join(own("a"), "a").join(own("b"), "b").select(
        "a", "b", "n", collocation_score(F.col("n"), F.col("n_a"), F.col("n_b"), F.lit(total)).alias("score"))
    return single, staging.stage(scored.filter(F.col("score") > threshold), "collocations")


def word_cloud_frequencies(df: DataFrame, text: str = "text", k: int = 200, threshold: float = COLLOCATION) -> DataFrame:
    """(term, n, rel): top-k words and collocations (stop words out), relative to the top count.

    A collocation's occurrences are taken off both its words; a word without any left is no term."""
    words = df.select(T.remove_stopwords(T.normalized_words(F.col(text))).alias("w"))
    single, pairs = collocations(words, threshold)
    taken = pairs.select(F.explode(F.array("a", "b")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("taken"))
    alone = single.join(taken, "word", "left").select(F.col("word").alias("term"), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
    both = alone.filter(F.col("n") > 0).unionByName(pairs.select(F.concat_ws(" ", "a", "b").alias("term"), "n"))
    top = both.orderBy(F.col("n").desc(), "term").limit(k)
    return top.withColumn("rel", F.col("n") / F.max("n").over(Window.partitionBy()))


def clean_words(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, words): the cleaned corpus as word arrays (what a sequence tokenizer sees)."""
    return df.select(key, T.lemmatize(T.remove_stopwords(T.normalized_words(F.col(text)))).alias("words"))


def word_counts(words: DataFrame, key: str = "id") -> DataFrame:
    """(term, n, first_id, first_pos): count and first occurrence (document order by key)."""
    x = words.select(key, F.posexplode("words").alias("pos", "term"))
    # one term-keyed aggregate: count and the (document, position) minimum both
    # combine map-side, so no (document, term) table is shuffled
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("n"),
                                 F.min(F.struct(F.col(key).alias("k"), F.col("pos").alias("p"))).alias("_f")) \
        .select("term", "n", F.col("_f.k").alias("first_id"), F.col("_f.p").cast("bigint").alias("first_pos"))


def token_index(words: DataFrame, key: str = "id") -> DataFrame:
    """(term, n, idx): 1-based rank by count, ties in first-seen order; computed across all tasks."""
    counts = word_counts(words, key)
    return row_number_by(counts.withColumn("_neg", -F.col("n")), [], ["_neg", "first_id", "first_pos"], "idx") \
        .select("term", "n", "idx")


def top_index(words: DataFrame, num_words: int, key: str = "id") -> DataFrame:
    """The index restricted to idx < num_words: a distributed top-k, then ranks over <= num_words rows."""
    counts = word_counts(words, key)
    top = counts.orderBy(F.col("n").desc(), "first_id", "first_pos").limit(num_words - 1)
    w = Window.orderBy(F.col("n").desc(), "first_id", "first_pos")
    return top.withColumn("idx", F.row_number().over(w).cast("bigint")).select("term", "n", "idx")


def _lookup(index: DataFrame, num_words: int) -> dict[str, int]:
    """The index below ``num_words`` on the driver: fewer than ``num_words`` entries by that parameter."""
    rows = index.filter(F.col("idx") < num_words).select("term", "idx").limit(num_words).collect()
    return {r["term"]: r["idx"] for r in rows}


#: Essays whose words a Python worker holds at a time.
ENCODED_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _encoder(spark, table: dict[str, int], unknown: int | None):
    """Arrow-batched in-row lookup of a word array; no word leaves its row, nothing is shuffled.

    The session's batches are made smaller if they are larger than ``ENCODED_ROWS``."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ENCODED_ROWS:
        spark.conf.set(_BATCH, str(ENCODED_ROWS))

    @F.pandas_udf("array<bigint>")
    def encode(words: pd.Series) -> pd.Series:
        if unknown is None:
            return words.map(lambda ws: [i for i in map(table.get, ws) if i is not None])
        return words.map(lambda ws: [table.get(w, unknown) for w in ws])

    return encode


def encode_sequences(words: DataFrame, index: DataFrame, num_words: int = 5000, key: str = "id") -> DataFrame:
    """(key, seq): word -> index, unknown words and indexes >= num_words dropped, order kept."""
    return words.select(key, _encoder(words.sparkSession, _lookup(index, num_words), None)("words").alias("seq"))


def pad_sequences(df: DataFrame, col: str = "seq", maxlen: int = 500, value: int = 0) -> DataFrame:
    """Left padding and left truncation (the last ``maxlen`` ids are kept)."""
    s = F.col(col)
    kept = F.slice(s, F.greatest(F.size(s) - (maxlen - 1), F.lit(1)), maxlen)
    padded = F.concat(F.array_repeat(F.lit(value).cast("bigint"), F.lit(maxlen) - F.size(kept)), kept)
    return df.withColumn("padded", padded)


CLS_ID, SEP_ID, UNK_ID, WORD_OFFSET = 1, 2, 3, 3


def encode_with_mask(words: DataFrame, index: DataFrame, num_words: int = 5000, max_len: int = 512,
                     key: str = "id") -> DataFrame:
    """(key, input_ids, attention_mask): [CLS] ids [SEP], right-truncated to max_len and
    right-padded to the longest row (at most max_len); unknown words map to [UNK]."""
    table = {w: i + WORD_OFFSET for w, i in _lookup(index, num_words).items()}
    cut = F.slice("words", 1, max_len - 2)  # before encoding: what is cut off is never looked up
    full = F.concat(F.array(F.lit(CLS_ID).cast("bigint")), _encoder(words.sparkSession, table, UNK_ID)(cut),
                    F.array(F.lit(SEP_ID).cast("bigint")))
    enc = words.select(key, full.alias("input_ids"))
    longest = words.agg(F.max(F.least(F.size("words"), F.lit(max_len - 2)))).first()[0]
    target = 2 + (longest or 0)
    padded = F.concat(F.col("input_ids"), F.array_repeat(F.lit(0).cast("bigint"), F.lit(target) - F.size("input_ids")))
    return enc.select(key, padded.alias("input_ids")).withColumn(
        "attention_mask", F.transform("input_ids", lambda x: F.when(x != 0, 1).otherwise(0)))


def as_double_array(col: str) -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def normalize_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """L2-normalise every vector (a zero vector stays null-free: divided by 1)."""
    v = as_double_array(vec)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    safe = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return df.withColumn(vec, F.transform(v, lambda x: x / safe))


def vectors_long(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("dim", "value")).withColumn("dim", F.col("dim").cast("bigint"))


def mean_vectors(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """(group, dim, value): per-dimension mean, a partial + final aggregate on (group, dim)."""
    x = df.select(group, F.posexplode(as_double_array(vec)).alias("dim", "value"))
    return x.groupBy(group, F.col("dim").cast("bigint").alias("dim")).agg(F.avg("value").alias("value"))


#: Rows of a block of essays at most, rows that make a block of their own worth while, blocks up to which the latter counts.
BLOCK_ROWS, LEAST_ROWS, SPREAD = 16_000, 1_000, 24
#: Entries of the (essay, word, value) sums that are laid out at a time.
SUM_ROWS = 20_000


def _block_means(dim: int, kind: pa.DataType):
    """Mean vectors of one block's essays: its words in place meet one row per word that it needs."""
    def means(text: pa.Table, given: pa.Table) -> pa.Table:
        keys, lists = text["k"].combine_chunks(), text["words"].combine_chunks()
        names = given["word"].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        table = np.zeros((len(names.dictionary), dim))
        np.add.at(table, code, given["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        copies = np.bincount(code, minlength=len(table))  # rows that the vectors have for a word
        own = keys.dictionary_encode().indices  # repeated keys share their words; a null key has none
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64), size)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names.dictionary), -1).to_numpy(zero_copy_only=False)
        held = (row >= 0) & (at >= 0)
        pair, times = np.unique(row[held] * max(len(table), 1) + at[held], return_counts=True)
        row, at = np.divmod(pair, max(len(table), 1))
        n = len(keys) + 1  # the last row stays zero, for null keys
        total, weight = np.zeros((n, dim)), np.bincount(row, times * copies[at], minlength=n)
        for lo in range(0, len(row), SUM_ROWS):
            r = row[lo:lo + SUM_ROWS]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            total[r[first]] += np.add.reduceat(table[at[lo:lo + SUM_ROWS]] * times[lo:lo + SUM_ROWS, None], first, axis=0)
        total /= np.maximum(weight, 1)[:, None]
        out = total[pc.fill_null(own, n - 1).to_numpy(zero_copy_only=False)]
        ends = pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32))
        return pa.table({"k": keys.cast(kind), "vector": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})
    return means


def average_word_vectors(words: DataFrame, vectors: DataFrame, dim: int, key: str = "id",
                         word_col: str = "word", vec_col: str = "vector") -> DataFrame:
    """(key, vector): mean of the vectors of an essay's known words (repeats count); zeros if none.

    Unlike ``Word2VecModel.transform`` this divides by the number of known
    words only.  Essays are dealt into blocks by their key; a block meets one row
    per word that it holds, and sums are made there, so neither a vector per word
    occurrence nor a partial sum per essay and task is ever shuffled.
    ``words`` is read three times: stage it.
    """
    rows = words.count()
    blocks = max(-(-rows // BLOCK_ROWS), min(-(-rows // LEAST_ROWS), SPREAD), 1)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = words.select(block.alias("block"), F.col(key).alias("k"), F.col("words"))
    needed = dealt.select(F.col("block").alias("part"), F.explode("words").alias("word")).distinct()
    given = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(word_col).alias("word"), F.col(vec_col).alias("v"))
    given = needed.join(given, "word")
    kind = dealt.schema["k"].dataType
    out = dealt.groupBy("block").cogroup(given.groupBy("part")).applyInArrow(
        _block_means(dim, to_arrow_type(kind)), f"k {kind.simpleString()}, vector array<double>")
    return out.withColumnRenamed("k", key)
