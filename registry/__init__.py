"""The registered queries and, for each, the same result in DuckDB's SQL."""
