"""Column functions: every function here maps columns to a column."""
