"""Ledger and account-statement analytics on Spark."""
