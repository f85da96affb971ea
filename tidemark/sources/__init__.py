"""Readers and writers: Parquet tables, binary logs and runs, manifests, settings."""
