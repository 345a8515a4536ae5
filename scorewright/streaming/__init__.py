"""Streaming use of the per-essay features.

The reference has no streaming operator.  The per-essay predictors of
``operators.textfeat`` are pure column expressions, so they run unchanged on
a streaming DataFrame; ``feature_stream`` wires that up for essays arriving
as Parquet files.  It is a convenience over existing operators, not an
additional query (nothing here is registered in ``__spark_entry__``).
"""

from scorewright.streaming.features import feature_stream  # noqa: F401
