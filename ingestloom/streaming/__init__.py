"""Incremental loads from a landing folder."""
