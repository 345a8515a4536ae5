"""Delimited text sources and sinks.

The essay corpus ships as one headered, tab-separated, Latin-1 file whose
quoted fields may hold tabs, newlines and doubled quotes.  ``multiLine``
parsing cannot split a file, so one file is one task: land it to Parquet
once (``sources.staging.stage``) and let every later job read Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COMMON = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t",
                   encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """Explicit schema (no inference pass); empty numeric cells read as null."""
    return (spark.read.schema(schema).option("header", str(header).lower()).option("sep", sep)
            .option("encoding", encoding).options(**_COMMON).option("mode", "FAILFAST").csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", encoding: str = "ISO-8859-1",
                    header: bool = True) -> None:
    (df.write.mode("overwrite").option("header", str(header).lower()).option("sep", sep)
     .option("encoding", encoding).option("quote", '"').option("escape", '"').option("quoteAll", "true")
     .csv(path))


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write without an index column and read back with the same schema (comma-separated, UTF-8)."""
    write_delimited(df, path, sep=",", encoding="UTF-8")
    return read_delimited(df.sparkSession, path, df.schema, sep=",", encoding="UTF-8")
