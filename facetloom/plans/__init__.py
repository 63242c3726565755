"""Whole jobs: raw files to enriched rows, to personas, to matches."""
