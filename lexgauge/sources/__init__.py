"""Readers and the adapters that shape driver tables into domain tables."""
