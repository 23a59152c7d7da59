"""Relational and retrieval operators; each takes and returns DataFrames."""
