"""Leakage-safe relational features, dependency profiling and gated evaluation on Spark DataFrames."""
