"""A document query engine on Spark: JSON queries compiled to DataFrames, managed collections, document functions."""
