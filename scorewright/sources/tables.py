"""Reading the input tables and binding them to the essay data model.

The essay model is ``id, topic, text, score``.  The driver's tables hold no
essays, so ``documents`` is bound to it (see README, "Data binding"):

* ``id`` = ``doc_id``, ``text`` = ``text``
* ``topic`` = ``lang`` (few, uneven groups: the modelling topic);
  ``source`` is kept for grouped statistics
* ``score`` = bit length of the whitespace word count -- an integer that
  grows with essay length, 1..15 on the given scales
* ``split_hash`` = stable 32-bit hash of ``id`` and the split seed, used by
  the train/test split and by the second synthetic rater
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.hashing import split_hash
from scorewright.functions.text import word_count


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


#: Session setting with which a caller may ask for that many partitions of the essays' texts (unset: as read).
INPUT_PARTITIONS = "spark.scorewright.input.partitions"


def as_asked(df: DataFrame) -> DataFrame:
    """Tables are read in the splits of their files.  A caller whose few files hold one row group each
    may set ``spark.scorewright.input.partitions``; nothing is moved otherwise, whatever the sizes."""
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def essay_score(text: Column) -> Column:
    """Synthetic human score: bit length of the word count (integer-exact)."""
    return F.length(F.bin(word_count(text))).cast("int")


def bind_essays(documents: DataFrame, seed: int = 26) -> DataFrame:
    """``documents`` -> essays(id, topic, source, text, n_chars, word_count, score, split_hash, rater1, rater2).

    All columns are lazy projections; Catalyst prunes the ones a query does
    not use, so e.g. the md5 hash is only computed when a split is needed.
    """
    wc = word_count(F.col("text"))
    h = split_hash(F.col("doc_id"), seed)
    score = F.length(F.bin(wc)).cast("int")
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("topic"),
        F.col("source"),
        F.col("text"),
        F.col("n_chars"),
        wc.alias("word_count"),
        score.alias("score"),
        h.alias("split_hash"),
    ).withColumns({
        "rater1": F.col("score"),
        "rater2": F.greatest(F.lit(1), F.col("score") + F.col("split_hash") % 3 - 1).cast("int"),
    })


def essays(spark: SparkSession, sf_dir: str, seed: int = 26) -> DataFrame:
    return bind_essays(as_asked(load(spark, sf_dir, "documents")), seed)
