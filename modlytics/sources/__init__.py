"""Landed payloads, tables and CSV files."""
