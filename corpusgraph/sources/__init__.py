"""Readers and the projections from raw records to papers."""
