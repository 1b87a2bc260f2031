"""Sequence analytics on Spark: k-mers, minimizers, super-k-mers and their statistics as DataFrames."""
