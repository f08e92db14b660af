"""Stored web pages to tables, as Spark jobs."""
