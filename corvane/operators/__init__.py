"""Relational and text operators on DataFrames."""
