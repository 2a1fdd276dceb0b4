"""Plan shapes shared by several operators: frequencies, ranks, per-column tables."""
