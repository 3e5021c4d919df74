"""Marts, reports and the registry of named queries."""
