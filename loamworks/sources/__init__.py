"""Readers, schemas, sinks, and stage outputs."""
