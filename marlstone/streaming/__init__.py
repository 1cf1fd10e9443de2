"""Structured Streaming over event tables and dataset versions."""
