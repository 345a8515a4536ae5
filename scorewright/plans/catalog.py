"""Query catalog: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Plans register themselves with ``@query(key, sql)``.  Oracle SQL runs in
DuckDB against views named after the driver tables.  Floating outputs of
"SQL~" checks are rounded to 6 decimals on both sides (``rounded``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (for order-insensitive value comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every plan module so that it registers its queries."""
    from scorewright.plans import (  # noqa: F401
        evaluation, joins_sets, models_q, profile_q, selection_q, sources_q, text_q, vocab_q,
    )
