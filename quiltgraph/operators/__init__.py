"""Operators on graphs and relations, as DataFrames."""
