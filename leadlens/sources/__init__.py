"""Scans and sources (S1-S8): driver Parquet, fixture tables, CSV, JDBC."""
