"""Reconciliation and decision analytics on Spark DataFrames."""
