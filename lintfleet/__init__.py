"""Audit of many databases and migration scripts as Spark jobs."""
