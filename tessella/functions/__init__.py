"""Scalar functions as Column expressions, and array kernels."""
