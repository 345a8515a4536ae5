"""Registered queries of the training-data operators: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import substring_dedup, suffix_dedup
from scorewright.llm.alignment import align
from scorewright.llm.common import documents
from scorewright.llm.decontam import decontaminate
from scorewright.llm.exact_dedup import exact_dedup
from scorewright.llm.language_id import language_id
from scorewright.llm.line_dedup import repeated_lines
from scorewright.llm.near_dedup import near_dedup
from scorewright.llm.packing import pack
from scorewright.llm.quality import quality
from scorewright.llm.spelling import spelling_variants
from scorewright.llm.token_records import token_records
from scorewright.llm.toxicity import toxicity
from scorewright.sources.tables import load

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLES["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), load(spark, sf_dir, "benchmark")).drop("spans")


ORACLES["op6_decontaminate"] = r"""
WITH lw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[s:s + 12], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM lw),
ahead AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM x),
hit AS (SELECT a.doc_id, a.i, p.m, p.item FROM ahead a JOIN pat p ON a.k = p.k WHERE p.m = 13 AND a.i + 12 <= a.n
        UNION ALL SELECT a.doc_id, a.i, p.m, p.item FROM ahead a JOIN (SELECT * FROM pat WHERE m < 13) p ON starts_with(a.k || ' ', p.k || ' ')),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT lw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeated_words(documents(spark, sf_dir)))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_bytes(documents(spark, sf_dir)))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


ORACLES["op8_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i AS start, lines[i:i + 2] AS run
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d)),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 3)) AS i FROM f WHERE place > 1),
l AS (SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
SELECT l.doc_id, any_value(n_lines) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id"""


def documents_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_text: bool) -> DataFrame:
    """A document's host is its source; the part of a source in one language is a path."""
    path = F.concat_ws("/", "source", F.coalesce("lang", F.lit("")))
    return quality(docs, load(spark, sf_dir, "labels"), F.col("source"), path, keep_text=keep_text)


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    scored = documents_quality(spark, docs, sf_dir, keep_text=False)
    return scored.select("doc_id", "p_quality", "p_toxic", "host_quality", "path_quality", "path_toxic", "quality",
                         "toxic", "kept")


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k
        FROM x QUALIFY i + 12 <= n),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (k) WHERE f < doc_id),
kept AS (SELECT x.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS kept
         FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


# crc32 from its definition: eight shifts of the reversed polynomial per byte value, one table step per UTF-8 byte
ORACLES["op12_spelling_variants"] = r"""
WITH t AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                       ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w
         FROM documents),
d AS (SELECT id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)]
                  ELSE [192 + (ord(x) >> 6), 128 + ord(x) % 64] END FOR x IN string_split(concat(id, ':', w), '')])),
                  lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8))) AS h
           FROM d, t),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(w, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
cut AS (SELECT DISTINCT word, n, concat(left(word, p - 1), substr(word, p + 1)) AS c FROM x),
hole AS (SELECT word, n, concat(left(word, p - 1), '_', substr(word, p + 1)) AS c FROM x),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM hole a JOIN hole b ON a.c = b.c AND a.word <> b.word
          UNION ALL SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.c = v.word
          UNION ALL SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.c = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
                 CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (WITH RECURSIVE w(word, here, n) AS (SELECT word, word, n FROM forms
         UNION ALL SELECT w.word, f.form, f.form_n FROM w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL)
         SELECT word, arg_max(here, n) AS root FROM w GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN walk USING (word)"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), keep_groups=False)


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), load(spark, sf_dir, "labels"))
