"""DataFrame operators. Each takes a DataFrame and column names and returns a DataFrame."""
