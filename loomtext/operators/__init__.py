"""Single steps.  Each takes DataFrames and returns a DataFrame."""
