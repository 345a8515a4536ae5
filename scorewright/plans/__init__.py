"""Registered queries: each key pairs a Spark plan with its DuckDB oracle."""
