"""Whole jobs: standardise a source, compile the panel, link it, report on it."""
