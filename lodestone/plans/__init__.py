"""Governed SQL and the reporting views."""
