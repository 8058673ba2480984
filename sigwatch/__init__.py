"""Telecom signalling fraud analytics as Spark jobs."""
