"""The logical plan that all dialects share, and its lowering to DataFrames."""
