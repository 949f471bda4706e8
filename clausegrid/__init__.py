"""Clause retrieval, evidence assembly and verification analytics on Spark DataFrames."""
