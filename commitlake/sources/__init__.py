"""Readers: Parquet tables, strict JSON lines, SQLite stores, git output."""
