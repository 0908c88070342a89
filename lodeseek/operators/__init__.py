"""Operators on DataFrames of tokens, queries, clusters, codes and results."""
