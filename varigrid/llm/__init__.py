"""Operators for building large training-data corpora, on DataFrames."""
