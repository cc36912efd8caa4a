"""Incremental star-schema refresh on Spark: sources, data contracts, Type 2
dimensions, cubes and run state, all as DataFrame operations."""
