"""Bindings of the operators to tables, and whole pipelines."""
