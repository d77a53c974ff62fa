"""Staged ingestion, validation and derived views on Spark DataFrames."""
