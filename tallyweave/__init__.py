"""Grouped ranking evaluation and sequence-variant data processing on Spark DataFrames."""
