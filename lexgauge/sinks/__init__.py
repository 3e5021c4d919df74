"""Writers: JSON, CSV and parquet exports, run logs."""
