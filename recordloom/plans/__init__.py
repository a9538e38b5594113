"""Whole plans: the linkage pipeline, and the registered queries with their SQL."""
