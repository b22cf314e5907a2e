"""DataFrame operators. Each takes DataFrames and plain parameters and returns DataFrames."""
