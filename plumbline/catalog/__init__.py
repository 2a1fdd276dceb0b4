"""Saved datasets, their lineage, and the history of analysis runs."""
