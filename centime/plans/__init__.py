"""plans of the ledger engine."""
