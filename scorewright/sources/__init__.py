from scorewright.sources.tables import essays, load, table_path  # noqa: F401
