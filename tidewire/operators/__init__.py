"""Operators on DataFrames; none depends on row positions."""
