"""Ledger reconciliation and analytics on Spark."""
