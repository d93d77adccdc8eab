"""Weak-label curation and relabelling on Spark DataFrames."""
