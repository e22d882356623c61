"""Readers of tables and raw files."""
