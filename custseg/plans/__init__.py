"""Named analyses (query registry) and their independent DuckDB oracle SQL."""
