"""DataFrame operators. Each takes and returns DataFrames; hub tables are materialized once."""
