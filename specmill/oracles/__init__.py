"""The queries in DuckDB's SQL."""
