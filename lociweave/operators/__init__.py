"""Analytic stages, each from DataFrames to a DataFrame."""
