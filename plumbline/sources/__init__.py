"""Readers that type and flatten files."""
