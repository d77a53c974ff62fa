"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it is present.
"""
