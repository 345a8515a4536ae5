"""Stable, partitioning-independent row hashing used for splits.

``randomSplit`` depends on partition layout and would give different rows
after a re-read or an executor loss; a hash of the key does not.  The same
expression is writable in DuckDB, which lets the oracle check splits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_hash(key: Column, seed: int) -> Column:
    """First 32 bits of md5("<key>:<seed>") as a non-negative bigint."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bucket_percent(key: Column, seed: int) -> Column:
    """0..99, uniform over keys."""
    return split_hash(key, seed) % 100
