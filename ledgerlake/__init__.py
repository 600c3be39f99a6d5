"""Retail-banking analytics on PySpark: every operator maps DataFrames to a DataFrame."""
