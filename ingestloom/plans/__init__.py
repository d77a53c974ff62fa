"""Whole plans: table store, staged loads, derived views."""
