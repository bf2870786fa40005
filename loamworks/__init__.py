"""Loamworks: corpus preparation and evaluation analytics as Spark DataFrame, SQL and streaming jobs."""
