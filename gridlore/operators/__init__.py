"""Operators over DataFrames: cleaning, profiling, correlation, outliers, trends, charts, models."""
