"""Operators for large training-data pipelines."""
