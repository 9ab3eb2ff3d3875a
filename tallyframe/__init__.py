"""Profiling, reconciliation, relationship discovery and audit sampling of tables, as Spark jobs."""
