"""Data-lake work on PySpark: sources, sinks, catalog, row changes, versions, nested data."""
