"""Scalar, list, temporal and aggregate functions as Column expressions."""
