"""Queries over the test tables, and the same queries in SQL."""
