"""The query catalogue and its DuckDB counterparts."""
