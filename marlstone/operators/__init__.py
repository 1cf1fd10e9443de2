"""Relational, sequence, sampling and search operators on DataFrames."""
