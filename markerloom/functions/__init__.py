"""Scalar kernels and column expressions."""
