"""Ledger analytics and cash planning on Spark DataFrames."""
