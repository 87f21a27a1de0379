"""SQL text of scalar functions, the same in Spark and in DuckDB."""
