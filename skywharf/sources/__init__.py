"""Readers, writers and payload flatteners; all return DataFrames in fixed schemas."""
