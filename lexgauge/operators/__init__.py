"""Checks, contracts, privacy pass, run ledger and snapshot comparison."""
