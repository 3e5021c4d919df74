"""Data-quality and regulatory-volatility analytics as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame; Catalyst and
AQE choose the physical strategy.
"""
