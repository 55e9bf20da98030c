"""Ledger reconciliation at scale, on Spark DataFrames."""
