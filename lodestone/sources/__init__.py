"""Readers for tabular files, HTML pages and JSON lines."""
