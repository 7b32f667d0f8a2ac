"""Queries over the tables of the test data."""
