"""Named queries over the shared tables, each with its DuckDB counterpart."""
