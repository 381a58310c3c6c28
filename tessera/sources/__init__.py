"""Readers for the engine's inputs (parquet tables, numbered text, TSV, JSON)."""
