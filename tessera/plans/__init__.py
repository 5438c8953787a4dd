"""Ledger schemas and the views of the driver's tables that play the ledger."""
