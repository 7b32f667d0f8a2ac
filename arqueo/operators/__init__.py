"""Operators on DataFrames that hold for any table of the right columns."""
