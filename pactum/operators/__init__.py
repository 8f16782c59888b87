"""Operators from DataFrames to DataFrames: cleaning, statistics, keys, privacy, generation, enrichment."""
