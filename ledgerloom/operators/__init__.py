"""Relational kernels: each takes and returns DataFrames."""
