"""Readers, writers and versioned datasets."""
