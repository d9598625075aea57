"""Readers for delimited and fixed-width extracts, and stage snapshots."""
