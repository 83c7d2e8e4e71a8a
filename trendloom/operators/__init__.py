"""DataFrame operators: everything here maps DataFrames to a DataFrame."""
