"""Readers of artifact files as typed DataFrames."""
