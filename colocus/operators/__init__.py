"""Operators on DataFrames, and numerical kernels that run per group."""
