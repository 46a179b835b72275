"""Bounded incremental ingest of observations."""
