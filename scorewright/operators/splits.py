"""Reproducible splits and folds.

Splits come from a hash of the key, never from ``randomSplit``: the hash
gives the same rows on every re-read, after an executor loss and in the
DuckDB oracle, and it keeps every part of one row (ids, masks, vectors) in
the same split because the split is a column, not a set of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.hashing import bucket_percent
from scorewright.operators.relational import ntile_by


def train_test(df: DataFrame, key: str = "id", seed: int = 26, train_pct: int = 70) -> DataFrame:
    b = bucket_percent(F.col(key), seed)
    return df.withColumn("split", F.when(b < train_pct, "train").otherwise("test"))


def train_val_test(df: DataFrame, key: str = "id", seed: int = 42, train_pct: int = 70,
                   val_pct: int = 15) -> DataFrame:
    b = bucket_percent(F.col(key), seed)
    return df.withColumn("split", F.when(b < train_pct, "train")
                         .when(b < train_pct + val_pct, "val").otherwise("test"))


def kfold(df: DataFrame, k: int = 5, group: str | None = "topic", order: str = "id",
          name: str = "fold") -> DataFrame:
    """Contiguous, unshuffled folds in key order (0-based), per group: ntile(k) - 1."""
    out = ntile_by(df, [group] if group else [], [order], k, name)
    return out.withColumn(name, F.col(name) - 1)
