"""Relational copy, subset, redact and restore operators on Spark DataFrames."""
