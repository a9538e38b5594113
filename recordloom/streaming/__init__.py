"""Incremental intake of records."""
